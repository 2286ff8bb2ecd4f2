"""The tables of an index on a shared file system: a base, newer deltas, and a pointer.

Every write goes to a folder of its own; the pointer file names the folders that count.
Replacing it is what makes a write visible, so readers never see half of one. A delta
holds all rows of the documents it changes, and their ids; a document's rows count only
in the newest folder that names it.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.postings import term_stats

TABLES = {
    "documents": "docid string, fields map<string,string>",
    "dynamic": "docid string, ts int, vars array<float>, cats map<string,string>",
    "postings": "field string, term string, docid string, positions array<int>, tf int, doc_len int",
}
#: Bytes of stored documents whose postings are sorted at once, in memory, and are one file.
RANGE_BYTES = 16 << 20
#: Row groups of stored documents in such a part. Their size is looked at after each row, as a text may be much longer than those before it.
ROW_GROUPS = 4
#: Tables whose rows a delta replaces; variables and categories change without new postings.
TEXT, DYNAMIC = ["documents", "postings"], ["dynamic"]


@dataclass
class Manifest:
    base: str | None = None
    deltas: list[str] = field(default_factory=list)
    functions: dict[str, str] = field(default_factory=dict)
    promotions: dict[str, str] = field(default_factory=dict)
    last_batch: int = -1
    #: Number of this state; each save makes the next one.
    version: int = 0


class Conflict(RuntimeError):
    """Another session has written since this one last read the pointer."""


#: Held while the size of splits, which is the session's, is another.
_SPLITTING = threading.Lock()


@contextmanager
def split_by(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run meanwhile reads files in parts of so many bytes at most."""
    name = "spark.sql.files.maxPartitionBytes"
    with _SPLITTING:
        before = spark.conf.get(name)
        spark.conf.set(name, str(size))
        try:
            yield
        finally:
            spark.conf.set(name, before)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest = self._load()

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _load(self) -> Manifest:
        if not self._fs.exists(self._path("CURRENT")):
            return Manifest()
        text = self.spark.read.text(f"{self.root}/CURRENT").first().value
        return Manifest(**json.loads(text))

    def save(self) -> None:
        """Makes the manifest's state the current one; a Conflict if another session's is newer than the one read."""
        if self._load().version != self.manifest.version:
            raise Conflict(f"{self.root} has changed; refresh and apply again")
        self.manifest.version += 1
        new = self._path(f".CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(asdict(self.manifest)).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        files.rename(files.makeQualified(new), files.makeQualified(self._path("CURRENT")), over)

    def refresh(self) -> None:
        """Takes up what other sessions have written."""
        self.manifest = self._load()

    def write(
        self, tables: dict[str, DataFrame | Callable[[DataFrame], DataFrame]], changed_text: DataFrame | None = None, changed_dynamic: DataFrame | None = None
    ) -> str:
        """Writes a folder: tables, and the ids whose text and dynamic rows it replaces.

        A function makes its table from the documents that the folder holds by then. A file of postings has those of
        some documents, in the order of their terms: stored documents are read in parts of about RANGE_BYTES, and their
        postings, which are several times larger, are sorted where they are made. Neither is shuffled.
        """
        name = f"v-{uuid.uuid4().hex}"
        for table, df in tables.items():
            path, made = f"{self.root}/{name}/{table}", callable(df)
            if made:
                df = df(self.spark.read.schema(TABLES["documents"]).parquet(f"{self.root}/{name}/documents"))
            elif table == "postings":
                n = self._parts(name)
                df = df.repartition(*[n] * (n > int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "docid")
            out = df.select(*[c.split(" ")[0] for c in TABLES[table].split(", ")])
            if table == "postings":
                # by the term first: nearly all rows have the same field, and Spark compares the first column fastest
                out = out.sortWithinPartitions("term", "field", "docid")
            if table == "documents":
                sizes = {"parquet.block.size": RANGE_BYTES // ROW_GROUPS, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
                out.write.options(**sizes).parquet(path)
            elif made:
                with split_by(self.spark, RANGE_BYTES):
                    out.write.parquet(path)
            else:
                out.write.parquet(path)
            if table == "postings":
                stats = term_stats(self.spark.read.parquet(path))
                stats.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{self.root}/{name}/term_stats")
        for kind, ids in (("text", changed_text), ("dynamic", changed_dynamic)):
            if ids is not None:
                ids.select("docid").write.parquet(f"{self.root}/{name}/changed_{kind}")
        return name

    def _parts(self, name: str) -> int:
        """Parts that the documents of a folder need for their postings to be sorted in memory."""
        return self._fs.getContentSummary(self._path(name, "documents")).getLength() // RANGE_BYTES + 1

    def read(self, table: str) -> DataFrame:
        """Current rows: those of the base and deltas that no newer delta replaces."""
        schema, folders = TABLES[table], [f for f in (self.manifest.base, *self.manifest.deltas) if f]
        changed = "changed_text" if table in TEXT else "changed_dynamic"
        empty = self.spark.createDataFrame([], schema)
        have = [(i, f) for i, f in enumerate(folders) if self._fs.exists(self._path(f, table))]
        if not have:
            return empty
        rows = [self.spark.read.schema(schema).parquet(f"{self.root}/{f}/{table}").withColumn("_v", F.lit(i)) for i, f in have]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        marks = [(i, f) for i, f in enumerate(folders) if i and self._fs.exists(self._path(f, changed))]
        if marks:
            ids = None
            for i, f in marks:
                own = self.spark.read.schema("docid string").parquet(f"{self.root}/{f}/{changed}").withColumn("_newest", F.lit(i))
                ids = own if ids is None else ids.unionByName(own)
            newest = ids.groupBy("docid").agg(F.max("_newest").alias("_newest"))
            out = out.join(newest, "docid", "left").where("_newest is null or _v >= _newest")
        return out.select(*[c.split(" ")[0] for c in schema.split(", ")])

    def term_stats(self) -> DataFrame:
        """(field, term, df, cnt) over all folders. A replaced document counts until the base is rewritten."""
        folders = [f for f in (self.manifest.base, *self.manifest.deltas) if f and self._fs.exists(self._path(f, "term_stats"))]
        schema = "field string, term string, df long, cnt long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}/term_stats" for f in folders])
        return rows.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt"))

    def clean(self, age: float = 3600) -> list[str]:
        """Deletes folders that the manifest no longer names and that have not changed for ``age`` seconds, as others may still read them."""
        keep = {self.manifest.base, *self.manifest.deltas}
        gone = []
        for status in self._fs.listStatus(self._path()):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in keep and time.time() - status.getModificationTime() / 1000 >= age:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return gone

    # terms of past queries: rows are only added

    def add_query_terms(self, counts: dict[str, int]) -> None:
        if counts:
            rows = self.spark.createDataFrame(list(counts.items()), "term string, cnt long")
            rows.coalesce(1).write.mode("append").parquet(f"{self.root}/query_terms")

    def query_terms(self) -> DataFrame:
        """(term, cnt) over all sessions."""
        schema = "term string, cnt long"
        if not self._fs.exists(self._path("query_terms")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/query_terms").groupBy("term").agg(F.sum("cnt").alias("cnt"))
