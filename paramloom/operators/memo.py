"""Memoised results: which inputs are known, and the tables that say so.

All of it works on whole sweeps: a DataFrame of inputs is joined to the stored
results once. Keys compare as canonical.matching has it (2 equals 2.0, null
only itself); a join deals both sides by key, so Spark may broadcast a small
side or split a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paramloom.functions.canonical import matching


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({f"_k_{k}": matching(F.col(k), df.schema[k].dataType) for k in keys})


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[f"_k_{k}"].eqNullSafe(right[f"_k_{k}"])
    return on


def hits(sweep: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the sweep whose key the store has."""
    a, b = _keyed(sweep, keys), _keyed(store, keys).select(*[f"_k_{k}" for k in keys])
    return a.join(b, _same(a, b, keys), "left_semi").select(*sweep.columns)


def misses(sweep: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the sweep whose key the store lacks."""
    a, b = _keyed(sweep, keys), _keyed(store, keys).select(*[f"_k_{k}" for k in keys])
    return a.join(b, _same(a, b, keys), "left_anti").select(*sweep.columns)


def recall(sweep: DataFrame, store: DataFrame, keys: list[str], values: list[str], compute: dict[str, Column]) -> DataFrame:
    """The sweep with the stored values where the key is known, else computed ones, and source (cache, computed).

    store has one row per key. For expressions this is one left join: a miss
    is computed in the same pass, without a second read of the sweep.
    """
    a = _keyed(sweep, keys)
    b = _keyed(store, keys).select(*[f"_k_{k}" for k in keys], *[F.col(v).alias(f"_v_{v}") for v in values], F.lit(True).alias("_hit"))
    joined = a.join(b, _same(a, b, keys), "left")
    hit = F.col("_hit").isNotNull()
    out = [F.when(hit, F.col(f"_v_{v}")).otherwise(compute[v]).alias(v) for v in values]
    return joined.select(*[a[c] for c in sweep.columns], *out, F.when(hit, "cache").otherwise("computed").alias("source"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in the given order: one map-side aggregation, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return top.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest]).select(*df.columns)


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count: what a single-row lookup must not meet."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def version_numbers(uses: DataFrame, step: str, fingerprint: str, at: list[str]) -> DataFrame:
    """(step, fingerprint, version): 0 for the fingerprint a step used first, and so on."""
    first = uses.groupBy(step, fingerprint).agg(F.min(F.struct(*at)).alias("first_use"))
    order = Window.partitionBy(step).orderBy("first_use")
    return first.select(step, fingerprint, (F.dense_rank().over(order) - 1).alias("version"))


def current_version(uses: DataFrame, step: str, version: str, at: list[str]) -> DataFrame:
    """The version that each step used last."""
    return uses.groupBy(step).agg(F.max_by(version, F.struct(*at)).alias("current_version"))


def next_version(steps: DataFrame, versions: DataFrame, step: str, version: str) -> DataFrame:
    """The number that a new version of each step gets."""
    top = versions.groupBy(step).agg(F.max(version).alias("_top"))
    return steps.select(step).distinct().join(top, step, "left").select(step, F.coalesce(F.col("_top") + 1, F.lit(0)).alias("next_version"))


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of two schemas (key, type) that one lacks or types otherwise."""
    a, b = left.select("key", F.col("type").alias("left_type")), right.select("key", F.col("type").alias("right_type"))
    return a.join(b, "key", "full").filter(~F.col("left_type").eqNullSafe(F.col("right_type")))


def overlay(sweep: DataFrame, base: dict[str, object]) -> DataFrame:
    """The sweep's columns over a base set, in the base's types: a null overrides nothing."""
    from paramloom.functions.canonical import TYPES, value_type

    out = []
    for key, value in base.items():
        kind = TYPES[value_type(value)]
        own = F.lit(value).cast(kind)
        out.append((F.coalesce(F.col(key).cast(kind), own) if key in sweep.columns else own).alias(key))
    return sweep.select(*[c for c in sweep.columns if c not in base], *out)


def merged_use(marks: DataFrame, key: str = "key", used: str = "used") -> DataFrame:
    return marks.groupBy(key).agg(F.bool_or(used).alias(used))


def visible(entries: DataFrame, settings: DataFrame) -> DataFrame:
    """entries (key, used, visible) under each of settings (show_unused, show_invisible)."""
    keep = (F.col("used") | F.col("show_unused")) & (F.col("visible") | F.col("show_invisible"))
    if settings.distinct().count() > 4:
        raise ValueError("there are four settings at most")
    return entries.crossJoin(F.broadcast(settings)).filter(keep)


def aliased(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """entries (id, key, ...) under the names of aliases (name, target)."""
    names = aliases.select("name", F.col("target").alias("key"))
    return entries.join(names, "key").drop("key").withColumnRenamed("name", "key")


def by_batch(results: DataFrame, parent: str, batch_id: str, columns: list[str]) -> DataFrame:
    """One row per parent with runs: its runs' results by batch id, of equal ids the last in the order of the columns."""
    one = results.groupBy(parent, batch_id).agg(F.max(F.struct(*columns)).alias("_r"))
    return one.groupBy(parent).agg(F.map_from_entries(F.collect_list(F.struct(batch_id, "_r"))).alias("runs"))


def folded(results: DataFrame, parent: str, order: str, columns: list[str]) -> DataFrame:
    """One row per parent: an array of each column in the given order, and the count."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    df = results.groupBy(parent).agg(rows.alias("_rows"))
    return df.select(parent, *[F.col(f"_rows.{c}").alias(c) for c in columns], F.size("_rows").alias("n"))
