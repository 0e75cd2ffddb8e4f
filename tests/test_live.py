"""The streamed report: state, crashes, and the table that it is written to."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillmark.model import canonical
from rillmark.operators import reports
from rillmark.sources import slices
from rillmark.streaming.keyed import KeyedTable
from rillmark.streaming.live import LiveReport

SF = "/root/testdata/sf0.001"
SCHEMA = "date date, transaction_id string, user_id string, product_id string, amount bigint, partition_id bigint, offset bigint"


class Crash(RuntimeError):
    pass


class Fault:
    """Raises at the nth call of a step."""

    def __init__(self, step, n):
        self.step, self.left = step, n

    def __call__(self, step):
        if step == self.step:
            self.left -= 1
            if self.left == 0:
                raise Crash(step)


def same(a, b):
    cols = ["date", "user_id", "product_id", "amount", "offset"]
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def staged(spark, path, per_slice=60):
    rows = canonical(spark, SF)
    n = slices.stage(rows.withColumn("slice", F.floor(F.col("offset") / per_slice)), "slice", path)
    return rows, n, lambda: slices.stream(spark, path, SCHEMA)


def test_slices_come_in_order(spark, tmp_path):
    rows, n, stream = staged(spark, f"file://{tmp_path}/in")
    seen = []
    stream().writeStream.foreachBatch(lambda d, i: seen.append([r[0] for r in d.select(F.floor(F.col("offset") / 60)).distinct().collect()])).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [[k] for k in range(n)] and n > 3


def test_slices_of_several_files_are_whole_batches(spark, tmp_path):
    """The last slice has a single row, and so fewer files than the others: it gets some without rows."""
    path, seen = f"file://{tmp_path}/in", []
    rows = canonical(spark, SF).where("partition_id = 0 and offset <= 120")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert slices.stage(rows.withColumn("slice", F.floor(F.col("offset") / 60)), "slice", path, 3) == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [len(list((tmp_path / "in" / f"_slice={k}").glob("part-*"))) for k in range(3)]
    assert files[0] > 1 and len(set(files)) == 1
    slices.stream(spark, path, SCHEMA).writeStream.foreachBatch(lambda d, i: seen.append(sorted(r[0] for r in d.select("offset").collect()))).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [list(range(60)), list(range(60, 120)), [120]]


@pytest.mark.parametrize("step", ["before write", "after write"])
def test_crash_and_restart(spark, tmp_path, step):
    rows, n, stream = staged(spark, f"file://{tmp_path}/in")
    live = LiveReport(spark, f"file://{tmp_path}/report", Fault(step, 3))
    with pytest.raises(Exception, match="Crash"):
        live.start(stream(), True).awaitTermination(120)
    assert not same(live.report(), reports.merged(reports.partials(rows)))
    again = LiveReport(spark, f"file://{tmp_path}/report")
    query = again.start(stream(), True)
    query.awaitTermination(120)
    assert same(again.report(), reports.merged(reports.partials(rows)))
    # state has a row a key, not a row a transaction
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == rows.select("date", "user_id", "product_id").distinct().count()
    assert "rocksdb" in str(state["customMetrics"]).lower()
    # the session's own provider is back
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_only_changed_keys_are_written(spark, tmp_path):
    day = dt.date(2025, 3, 1)
    made = [(day, f"t{k}", "hot" if k % 2 else f"u{k}", "p", 1, 0, k, k // 4) for k in range(20)]
    slices.stage(spark.createDataFrame(made, f"{SCHEMA}, slice bigint"), "slice", f"file://{tmp_path}/in")
    live = LiveReport(spark, f"file://{tmp_path}/report")
    live.start(slices.stream(spark, f"file://{tmp_path}/in", SCHEMA), True).awaitTermination(120)
    for k in range(5):
        run = spark.read.parquet(f"file://{tmp_path}/report/table/runs/{k:020d}-0")
        assert {(r.user_id, r.amount) for r in run.collect()} == {("hot", 2 * k + 2), (f"u{4 * k}", 1), (f"u{4 * k + 2}", 1)}
    assert {r.user_id: r.amount for r in live.report().collect()}["hot"] == 10


def put(spark, table, batch, rows):
    table.put(spark.createDataFrame(rows, "k bigint, v string"), batch)


def test_levels(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], fan=3)
    assert table.rows() is None
    for b in range(20):
        put(spark, table, b, [(b % 7, f"v{b}"), (100, f"v{b}"), (None, f"n{b}")])
        put(spark, table, b, [(100, "a replay is left out")])
        assert len(table.runs()) <= 2 * 3 and table.runs() == sorted(table.runs(), key=lambda r: (-r[0], r[1]))
    want = {k: f"v{max(b for b in range(20) if b % 7 == k)}" for k in range(7)} | {100: "v19", None: "n19"}
    assert {r.k: r.v for r in table.rows().collect()} == want and table.rows().count() == 9
    put(spark, table, 25, [(0, "after a gap")])
    assert {r.k: r.v for r in table.rows().collect()}[0] == "after a gap"


def test_a_merge_that_ended_half_way(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], fan=2)
    put(spark, table, 0, [(1, "a")])
    monkeypatch.setattr(table, "_newest", lambda rows: (_ for _ in ()).throw(Crash("merge")))
    with pytest.raises(Crash):
        put(spark, table, 1, [(1, "b"), (2, "c")])
    again = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], fan=2)
    put(spark, again, 1, [(9, "a replay is left out")])
    put(spark, again, 2, [(2, "d")])
    assert {r.k: r.v for r in again.rows().collect()} == {1: "b", 2: "d"}


def test_newest_rows_without_a_sort(spark, tmp_path):
    """Numbers of a key are taken by hash aggregates; a newer null counts as well."""
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"])
    for b, rows in enumerate(([("a", 1, 9), ("b", 2, 8)], [("a", None, 7), ("c", 3, None)])):
        table.put(spark.createDataFrame(rows, "k string, amount bigint, offset bigint"), b)
    assert sorted(tuple(r) for r in table.rows().collect()) == [("a", None, 7), ("b", 2, 8), ("c", 3, None)]
    plan = table.rows()._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
