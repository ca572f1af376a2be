"""Small tables with every difficulty, and plain-Python versions."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with the names that operators use inside.
CLASHES = ["row_id", "doc", "n", "h", "kept", "shard", "node", "value", "component", "q_n_words", "_p", "length", "removed_spans", "name", "size", "p"]


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(n))


def hard_rows() -> list[tuple]:
    base, long = words(60, 1), words(30_000, 2)
    near = base.split()
    near[5] = "changed"
    return [
        (1, base, "en", "s0", 1),
        (2, base, "en", "s0", 1),
        (3, " ".join(near), "en", "s0", 1),
        (4, "", "en", "s1", 0),
        (5, None, None, None, None),
        (6, " \t\n", "de", "s1", 3),
        (7, "one two", "de", "s1", 7),
        (7, "one two", "de", "s1", 7),
        (None, words(40, 3), "fr", "s2", 9),
        (None, None, None, "s2", None),
        (8, long, "fr", "s2", len(long)),
        (9, long, "fr", "s3", len(long)),
        (10, "\n".join([words(12, 5)] * 8), "es", "s3", 8),
        (11, "#$%* &&& ||| <> " * 30, "es", "s3", 8),
        (12, "ünïcödé " * 20 + "日本語 <|endoftext|> x", "es", "s3", 8),
        (13, base.upper(), "en", "s0", 1),
    ]


def hard(spark, clashing: bool = False):
    df = spark.createDataFrame(hard_rows(), SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
