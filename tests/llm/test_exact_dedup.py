import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skimlight.llm.exact_dedup import exact_dedup, merge_round, sorted_run

from .helpers import empty, odd_documents, table


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        stays = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == low and not stays
            stays |= kept
            out.append((i, low, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize(("fanout", "levels"), [(2, 3), (16, 2), (4, 1)])
def test_brute(spark, fanout, levels, clashing):
    rows = odd_documents()
    got = exact_dedup(table(spark, rows, clashing=clashing), fanout=fanout, levels=levels)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_all_ids_null(spark):
    rows = [(None, "a", None, None, None)] * 3
    got = exact_dedup(table(spark, rows)).collect()
    assert [r.kept for r in got].count(True) == 1 and {r.group_size for r in got} == {3}


def test_empty(spark):
    assert exact_dedup(empty(spark)).collect() == []


def test_no_python(spark):
    plan = exact_dedup(table(spark, odd_documents()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_plan_of_the_tree(spark):
    """Sorted runs and no join on the way up: one exchange for the runs, one a round, two for the way back."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = exact_dedup(table(spark, odd_documents()), fanout=4, levels=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 5 and plan.count("Join") == 1


def test_rounds_merge_to_one_range_a_run(spark):
    rows = [(i, f"text {i % 50}", None, None, None) for i in range(400)]
    docs = table(spark, rows)
    entries = docs.select(
        F.unhex(F.sha2("text", 256)).alias("sha"), F.unhex(F.md5("text")).alias("md5"), F.length("text").alias("chars"), F.pmod(F.xxhash64("doc_id"), F.lit(27)).alias("run"),
        F.struct(F.lit(False).alias("without"), F.col("doc_id").alias("id"), F.col("doc_id").alias("row")).alias("low"),
    )
    entries = sorted_run(entries, F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("runs", F.array("run"))
    before = entries.count()
    for level in (1, 2, 3):
        entries = merge_round(entries, level, 3)
        now = entries.collect()
        assert len(now) < before and sum(r.n for r in now) == 400
        before = len(now)
    assert before == 50 and {r.low.id for r in now} == set(range(50))
    by_range = sorted(now, key=lambda r: r.sha)
    assert [r.run for r in by_range] == sorted(r.run for r in by_range)  # a run is a range of digests


def test_null_ids_are_spread(spark):
    rows = [(None, f"t{i % 3}", None, None, None) for i in range(300)]
    got = exact_dedup(table(spark, rows)).collect()
    assert sum(r.kept for r in got) == 3 and all(r.keep_id is None and r.group_size == 100 for r in got)
