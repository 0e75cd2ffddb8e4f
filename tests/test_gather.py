"""Ranges in progress in keyed state."""

import datetime as dt
import os
import time

import numpy as np
import pytest

from rillmark.model import RANGES
from rillmark.operators import ranges as R
from rillmark.sources import slices
from rillmark.streaming.gather import _outside, _runs, gather, joined
from rillmark.streaming.live import rocksdb

ROWS = "partition_id bigint, offset bigint, amount bigint"


class Sink:
    """Rows by batch; a batch that comes again replaces what it gave."""

    def __init__(self, crash_at=None):
        self.got, self.crash_at = {}, crash_at

    def __call__(self, df, batch):
        self.got[batch] = [r.asDict() for r in df.collect()]
        if batch == self.crash_at:
            self.crash_at = None
            raise RuntimeError("Crash")

    def rows(self, kind):
        return [r for b in sorted(self.got) for r in self.got[b] if r["kind"] == kind]


def run(spark, tmp_path, parts, ledger, sink, timeout=None, available=True):
    root = f"file://{tmp_path}"
    if parts is not None:
        made = [(p, o, a, k) for k, part in enumerate(parts) for p, o, a in part]
        slices.stage(spark.createDataFrame(made, f"{ROWS}, slice bigint"), "slice", f"{root}/in")
    found = R.classify(slices.stream(spark, f"{root}/in", ROWS), spark.createDataFrame(ledger, RANGES))
    writer = gather(found, ["offset", "amount"], timeout).writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/c")
    with rocksdb(spark, **{"spark.sql.shuffle.partitions": "2"}):
        query = (writer.trigger(availableNow=True) if available else writer.trigger(processingTime="200 milliseconds")).start()
    return query


def test_joined():
    assert joined([[5, 6], [1, 2], [3, 3], [9, 9]]) == [[1, 3], [5, 6], [9, 9]]


@pytest.mark.parametrize("crash_at", [None, 1, 2])
def test_three_overlapping_parts(spark, tmp_path, crash_at):
    # the case table of accumulate: 100-104 in three parts; rows outside, of a completed range and of an unknown partition
    parts = [
        [(1, 100, 1), (1, 101, 1), (2, 7, 1), (3, 0, 1), (1, 99, 1)],
        [(1, 101, 2), (1, 102, 2), (1, 103, 2), (1, 105, 2)],
        [(1, 104, 3), (1, 104, 3), (1, 100, 3)],
        [(1, 104, 4), (1, 100, 4)],
    ]
    ledger, sink = [(1, 100, 104, 1), (2, 5, 9, 2)], Sink(crash_at)
    if crash_at is not None:
        with pytest.raises(Exception, match="Crash"):
            run(spark, tmp_path, parts, ledger, sink).awaitTermination(120)
        parts = None
    run(spark, tmp_path, parts, ledger, sink).awaitTermination(120)
    got = sink.rows("whole")
    assert sorted((r["partition_id"], r["offset"], r["amount"]) for r in got) == [(1, 100, 1), (1, 101, 1), (1, 102, 2), (1, 103, 2), (1, 104, 3)]
    assert {(r["min_offset"], r["max_offset"], r["missing"]) for r in got} == {(100, 104, 0)}
    assert sink.rows("incomplete") == []


def test_a_range_that_is_never_whole(spark, tmp_path):
    sink = Sink()
    query = run(spark, tmp_path, [[(1, 0, 1), (1, 3, 1), (2, 0, 1), (2, 1, 1)]], [(1, 0, 4, 1), (2, 0, 1, 1)], sink, timeout=1.0, available=False)
    try:
        until = time.monotonic() + 60
        while not sink.rows("incomplete") and time.monotonic() < until:
            assert query.exception() is None
            time.sleep(0.2)
    finally:
        query.stop()
    assert [(r["partition_id"], r["min_offset"], r["max_offset"], r["missing"], r["offset"]) for r in sink.rows("incomplete")] == [(1, 0, 4, 3, None)]
    assert sorted((r["partition_id"], r["offset"]) for r in sink.rows("whole")) == [(2, 0), (2, 1)]


def test_intervals_of_many_offsets():
    r = np.random.default_rng(5)
    for _ in range(50):
        seen = r.choice(200, r.integers(1, 150), replace=False)
        covered = _runs(seen)
        assert covered == joined([[int(o), int(o)] for o in seen])
        assert _outside(np.arange(-3, 210), covered).tolist() == [o not in set(seen.tolist()) for o in range(-3, 210)]
    assert _outside(np.arange(3), []).all()


def test_columns_of_other_kinds_and_nulls(spark, tmp_path):
    """What is kept in state comes out as it went in, from a file of each of two parts of several files."""
    schema = "partition_id bigint, offset bigint, amount bigint, name string, day date, class string, stored_min bigint, stored_max bigint, stored_state tinyint"
    rows = [(0, o, None if o % 3 == 0 else o, None if o % 4 == 1 else f"n{o}", None if o == 7 else dt.date(2025, 3, 1 + o), R.OLD, 0, 9, 1) for o in range(10)]
    root, sink = f"file://{tmp_path}", Sink()
    made = spark.createDataFrame(rows, schema).selectExpr("*", "floor(offset / 6) as slice")
    assert slices.stage(made, "slice", f"{root}/in", 3) == 2
    folders = [d for d in os.listdir(f"{tmp_path}/in") if d.startswith("_slice=")]
    assert len({len([f for f in os.listdir(f"{tmp_path}/in/{d}") if f.startswith("part-")]) for d in folders}) == 1
    found = gather(slices.stream(spark, f"{root}/in", schema), ["offset", "amount", "name", "day"])
    with rocksdb(spark, **{"spark.sql.shuffle.partitions": "2"}):
        found.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((g["offset"], g["amount"], g["name"], g["day"]) for g in sink.rows("whole")) == [r[1:5] for r in rows]
