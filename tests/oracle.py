"""Comparison of a query with its SQL over the driver's tables."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{sf_dir}/{table}.parquet"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con.sql(sql).df()


def rows(df) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def check(spark, query, sql: str, sf_dir: str) -> None:
    ours, theirs = query(spark, sf_dir).toPandas(), run_sql(sql, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
