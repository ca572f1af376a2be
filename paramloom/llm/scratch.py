"""Tables in the shared folder that cut lineage, and helpers for worker state.

Intermediate tables are Parquet under ``spark.checkpoint.dir``: every executor
reads them, so a lost executor costs a re-read, never a recomputation of an
iterative plan. They go when the JVM ends, or earlier through ``drop``.
"""

from __future__ import annotations

import sys
import tempfile
import types
import urllib.parse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIR = "spark.checkpoint.dir"
#: Rows of a few numbers each that may be broadcast (some 12 MB of data).
SMALL = 500_000
#: Files of a table that small.
FEW = 8


#: Folders of local sessions that name none, by application: the setting can't be changed while one runs.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session without one gets its own."""
    place = spark.conf.get(DIR, None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError(f"{DIR} must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        place = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="paramloom-")
    return place


class Scratch:
    """Named intermediate tables of one operator call."""

    #: Where the folders of the running stage are noted, if a stage runs.
    made: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        if Scratch.made is not None:
            Scratch.made.append(self)

    def save(self, df: DataFrame, label: str, most: int | None = None) -> DataFrame:
        """most: a proven bound of the row count, of ids and numbers. A table of at most SMALL rows goes to a few files, not one a partition."""
        path = f"{self.root}/{label}"
        if most is not None and most <= SMALL:
            df = df.coalesce(FEW)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            self._fs.delete(self._path(f"{self.root}/{label}"), True)


    def free(self) -> None:
        self._fs.delete(self._path(self.root), True)


_through: list[Scratch] = []


def as_stage(docs: DataFrame, apply: Callable[[], DataFrame]) -> DataFrame:
    """Runs one stage of a pipeline whose results are written before the next stage begins.

    So the tables of earlier stages go now, if docs is read from files and
    none of these lies among them. An input without files (in memory) frees
    nothing: it may still wait for those tables.
    """
    files = [urllib.parse.unquote(urllib.parse.urlparse(f).path) for f in docs.inputFiles()]
    for old in list(_through) if files else ():
        folder = urllib.parse.urlparse(old.root).path + "/"
        if not any(f.startswith(folder) for f in files):
            old.free()
            _through.remove(old)
    outer, Scratch.made = Scratch.made, []
    try:
        result = apply()
        _through.extend(Scratch.made)
    finally:
        Scratch.made = outer
    return result


def named(scratch: Scratch, keys: DataFrame, label: str, name: str = "name", most: int | None = None) -> DataFrame:
    """Distinct rows of ``keys`` with an integer name each, in sort order.

    The rows are range partitioned and sorted; the name is the partition and
    the place in it, so no task sees more than its range.
    """
    cols = keys.columns
    ordered = keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return scratch.save(ordered.withColumn(name, F.monotonically_increasing_id()), label, most)


def if_small(stored: DataFrame, rows: int = SMALL) -> DataFrame:
    """A stored table of ids, marked for broadcast if it has at most so many rows; else the join shuffles."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def without(scratch: Scratch, rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows (with row_id) except those of dropped: texts stay where they are unless very many go."""
    return rows.join(if_small(scratch.save(dropped.select("row_id"), "dropped")), "row_id", "left_anti")


def boxed(docs: DataFrame) -> DataFrame:
    """doc (all columns as one struct), doc_id and text: no column of docs can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")


def numbered_rows(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """docs boxed and stored with a row_id each."""
    return scratch.save(boxed(docs).select("doc").withColumn("row_id", F.monotonically_increasing_id()), "rows")


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("doc.*")


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts may be long: hand Python workers batches of few rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    box = sys.modules.get("_paramloom_worker_state")
    if box is None:
        box = types.ModuleType("_paramloom_worker_state")
        box.state = {}
        sys.modules["_paramloom_worker_state"] = box
    return box.state


def text_or_empty(column: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
