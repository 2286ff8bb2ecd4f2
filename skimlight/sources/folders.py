"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no shared folder and runs on one machine (tests).
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, if that is unset, LOCAL_FOLDER."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
