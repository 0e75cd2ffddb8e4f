"""Every query of the library against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from rillmark.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted(map(str, (tuple(plain(r[i]) for i in order) for r in data)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in catalog.oracle_sql():
        result = duck.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, result.fetchall())


def test_merge_covers_the_stream(spark):
    sf = "/root/testdata/sf0.01"
    offsets = catalog.queries()["raw_transactions"](spark, sf).select("partition_id", "offset")
    assert offsets.where("offset >= 2500").count() > 0
    merged = catalog.queries()["merge_pending"](spark, sf).select("partition_id", "offset")
    assert offsets.exceptAll(merged).count() == merged.exceptAll(offsets).count() == 0


def test_overlaps_cover_the_stream(spark):
    sf = "/root/testdata/sf0.01"
    starts = {(r.partition_id, r.min_offset) for r in catalog.queries()["range_state"](spark, sf).collect()}
    got = catalog.queries()["range_overlaps"](spark, sf).collect()
    assert {(r.partition_id, r.min_offset - 250) for r in got} == starts == {(r.partition_id, r.written_min) for r in got}
    assert any(m // 1000 % 2 for _, m in starts)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["raw_sum", "raw_row_count", "distinct_transactions", "full_row_fetch", "dataset_totals", "reports_sum", "reports_daily", "shard_route"])
def test_one_scan_without_offsets(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert "Join" not in plan and "Window" not in plan
