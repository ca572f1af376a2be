import os

import pytest

from paramloom import catalog
from tests.oracle import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_hits_and_misses_part_the_sweep(spark):
    hits = catalog.QUERIES["q07_memo_hits"](spark, SF)
    misses = catalog.QUERIES["q08_memo_misses"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert hits.count() + misses.count() == events.count()
    assert hits.join(misses, "event_id").count() == 0


def test_second_study_run_is_all_cache(spark):
    assert [r.source for r in catalog.QUERIES["q51_study_sweep"](spark, SF).select("source").distinct().collect()] == ["cache"]


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["event_id", "value", "result", "source"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
