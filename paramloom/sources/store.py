"""The result store: steps, their versions, and results, as partitioned Parquet.

Results are appended, never rewritten in place: of equal keys the last write
counts, which a reader finds with one aggregation over a step's partition.
``compact`` rewrites a step without its superseded rows. One writer per step
at a time; concurrent readers see whole appends.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.functions.canonical import address, canonical
from paramloom.operators.memo import latest

STEP = "name string, description string, current_version int, seq long"
VERSION = "name string, version int, changelog string, env_schema map<string,string>, file_schema map<string,struct<writer:string,root:string>>, seq long"
RESULT = (
    "environment array<struct<key:string,cls:string,text:string>>, env_key string, data string, file_path string,"
    " version int, created_at timestamp, run_id string, seq long, step string"
)
TABLES = {"step": (STEP, ["name"]), "step_version": (VERSION, ["name", "version"]), "result": (RESULT, ["step", "version", "env_key", "created_at"])}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._last = 0
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.create()

    def create(self) -> None:
        """Makes the tables that aren't there."""
        for name in TABLES:
            self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def clear(self, step: str | None = None) -> None:
        """Forgets all results, or those of one step."""
        where = self.path("result") if step is None else f"{self.path('result')}/step={step}"
        self._fs.delete(self._path(where), True)
        self.create()

    def raw(self, table: str) -> DataFrame:
        """Every row ever written."""
        return self.spark.read.schema(TABLES[table][0]).parquet(self.path(table))

    def table(self, table: str) -> DataFrame:
        """The rows that count: the last written per key."""
        return latest(self.raw(table), TABLES[table][1], ["seq"])

    def _sequence(self) -> int:
        """A number above all earlier ones of this store's writer."""
        self._last = max(time.time_ns(), self._last + 1)
        return self._last

    def _append(self, table: str, df: DataFrame) -> None:
        writer = df.write.mode("append")
        (writer.partitionBy("step") if table == "result" else writer).parquet(self.path(table))

    # steps and versions

    def step(self, name: str):
        return self.table("step").filter(F.col("name") == name).first()

    def version_row(self, name: str, version: int):
        return self.table("step_version").filter((F.col("name") == name) & (F.col("version") == version)).first()

    def version_of(self, name: str, env_schema: dict[str, str], file_schema: dict[str, tuple[str, str]] | None = None, changelog: str = "", description: str = "") -> int:
        """The version of a step with these schemas, a new one if there is none; it becomes the current one."""
        known = self.table("step_version").filter(F.col("name") == name).collect()  # the versions of one step
        files = {k: tuple(v) for k, v in (file_schema or {}).items()}
        number = next((r.version for r in known if dict(r.env_schema or {}) == env_schema and {k: tuple(v) for k, v in (r.file_schema or {}).items()} == files), None)
        if number is None:
            number = max((r.version for r in known), default=-1) + 1
            row = (name, number, changelog, env_schema, files or None, self._sequence())
            self._append("step_version", self.spark.createDataFrame([row], VERSION))
        now = self.step(name)
        if now is None or now.current_version != number:
            self._append("step", self.spark.createDataFrame([(name, description, number, self._sequence())], STEP))
        return number

    def register_all(self, versions: DataFrame) -> None:
        """Records many versions at once: rows of (name, version, changelog, env_schema, current), current telling which one a step is at."""
        seq = F.lit(self._sequence())
        rows = versions.withColumn("file_schema", F.lit(None).cast("map<string,struct<writer:string,root:string>>")).withColumn("seq", seq)
        self._append("step_version", rows.select("name", F.col("version").cast("int").alias("version"), "changelog", "env_schema", "file_schema", "seq"))
        now = versions.filter("current").select("name", F.lit("").alias("description"), F.col("version").cast("int").alias("current_version"), seq.alias("seq"))
        self._append("step", now)

    def version_like(self, name: str, env_schema: dict[str, str]) -> DataFrame:
        """The versions of a step with these parameters, whatever their order: maps don't compare, their sorted entries do."""
        want = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(env_schema.items())])
        have = F.sort_array(F.map_entries("env_schema"))
        return self.table("step_version").filter((F.col("name") == name) & (have == want))

    # results

    def results(self, step: str, version: int | None = None, history: bool = False) -> DataFrame:
        """The results that count of a step (of one version); history: the time-stamped ones."""
        rows = self.raw("result").filter(F.col("step") == step)
        if version is not None:
            rows = rows.filter(F.col("version") == version)
        if history:
            return rows.filter(F.col("created_at").isNotNull())
        return latest(rows.filter(F.col("created_at").isNull()), ["version", "env_key"], ["seq"])

    def find(self, step: str, version: int, values: dict[str, Any]):
        """The stored row for one set of stored values, or None."""
        return self.results(step, version).filter(F.col("env_key") == address(values)).first()

    def save(self, step: str, version: int, values: dict[str, Any], data: dict | None, file_path: str | None = None, history: bool = False) -> str:
        """Writes one result; returns its run id."""
        run = uuid.uuid4().hex
        row = (canonical(values), address(values), None if data is None else json.dumps(data), file_path, version, None, run, self._sequence(), step)
        df = self.spark.createDataFrame([row], RESULT)
        self._append("result", df.withColumn("created_at", F.current_timestamp()) if history else df)
        return run

    def save_all(self, step: str, version: int, results: DataFrame, history: bool = False) -> None:
        """Writes many: rows of (environment, env_key, data, file_path)."""
        stamp = F.current_timestamp() if history else F.lit(None).cast("timestamp")
        self._append(
            "result",
            results.select(
                "environment", "env_key", "data", "file_path", F.lit(version).cast("int").alias("version"), stamp.alias("created_at"),
                F.expr("uuid()").alias("run_id"), F.lit(self._sequence()).alias("seq"), F.lit(step).alias("step"),
            ),
        )

    def save_rows(self, results: DataFrame) -> None:
        """Writes results of many steps: rows of (step, version, environment, env_key, data, created_at, seq); seq orders equal keys."""
        base = self._sequence()
        self._append(
            "result",
            results.select(
                "environment", "env_key", "data", F.lit(None).cast("string").alias("file_path"), F.col("version").cast("int").alias("version"),
                F.col("created_at").cast("timestamp").alias("created_at"), F.expr("uuid()").alias("run_id"), (F.lit(base) + F.col("seq")).alias("seq"), "step",
            ),
        )

    def compact(self, step: str) -> None:
        """Rewrites a step's partition without superseded rows: written beside it, then swapped in."""
        keep = latest(self.raw("result").filter(F.col("step") == step), TABLES["result"][1], ["seq"])
        fresh, place = f"{self.root}/_compact-{uuid.uuid4().hex}", f"{self.path('result')}/step={step}"
        keep.drop("step").write.parquet(fresh)
        old = f"{fresh}-old"
        self._fs.rename(self._path(place), self._path(old))
        self._fs.rename(self._path(fresh), self._path(place))
        self._fs.delete(self._path(old), True)

    # introspection

    def catalogue(self) -> DataFrame:
        """Steps with their versions and results (left joins: a version without results shows once)."""
        steps = self.table("step").select("name", "description", "current_version")
        versions = self.table("step_version").select("name", "version", "changelog", "env_schema")
        rows = self.table("result").select(F.col("step").alias("name"), "version", "env_key", "data", "file_path", "created_at")
        return steps.join(versions, "name", "left").join(rows, ["name", "version"], "left")

    def orphans(self) -> DataFrame:
        """Results whose version isn't recorded."""
        rows = self.table("result").withColumnRenamed("step", "name")
        return rows.join(self.table("step_version").select("name", "version"), ["name", "version"], "left_anti")
