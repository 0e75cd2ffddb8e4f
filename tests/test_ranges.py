"""The range operators against tables of cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rillmark.model import RANGES, State
from rillmark.operators import ranges as R


def records(spark, offsets, partition=7, tag="a"):
    return spark.createDataFrame([(partition, o, tag) for o in offsets], "partition_id bigint, offset bigint, tag string")


def ledger(spark, low=None, high=None, state=State.COMPLETED, partition=7):
    return spark.createDataFrame([] if low is None else [(partition, low, high, int(state))], RANGES)


@pytest.mark.parametrize(
    ("offsets", "low", "high", "want"),
    [
        ([100, 101, 102, 103], 100, 103, True),
        ([100], 100, 100, True),
        ([100, 101], 100, 103, False),
        ([101, 102, 103], 100, 103, False),
        ([100, 101, 102], 100, 103, False),
        ([100, 101, 103], 100, 103, False),
        ([100, 100, 102], 100, 102, False),
    ],
)
def test_covers_full_range(spark, offsets, low, high, want):
    got = R.covers_full_range(R.range_state(records(spark, offsets)), ledger(spark, low, high)).head()
    assert got.covers is want


@pytest.mark.parametrize(
    ("pending", "incoming", "want"),
    [
        ([], [100, 101], [100, 101]),
        ([100, 101], [102, 103], [100, 101, 102, 103]),
        ([100, 101, 102], [101, 102, 103], [100, 101, 102, 103]),
        ([102], [100, 101], [100, 101, 102]),
        ([100, 101], [100, 101], [100, 101]),
    ],
)
def test_merge_pending(spark, pending, incoming, want):
    merged = R.merge_pending(records(spark, pending), records(spark, incoming, tag="b")).orderBy("offset").collect()
    assert [r.offset for r in merged] == want
    assert [r.tag for r in merged] == ["a" if o in pending else "b" for o in want]


def test_accumulate_until_whole(spark):
    stored = ledger(spark, 100, 104, State.IN_PROGRESS)
    held = records(spark, [])
    for part, whole in (([100, 101], False), ([101, 102, 103], False), ([104], True)):
        held, seen = R.accumulate(held, records(spark, part), stored)
        assert seen.head().covers is whole


@pytest.mark.parametrize(
    ("offsets", "bad"),
    [(range(100, 110), None), ([100, 101, 102], None), (range(105, 110), None), ([98, 99, 100], "contained"), ([108, 109, 110], "contained"), ([100, 102], "contiguous"), ([100, 100, 102], "contiguous")],
)
def test_validate_old(spark, offsets, bad):
    error = R.validate_old(R.range_state(records(spark, offsets)), ledger(spark, 100, 109, State.IN_PROGRESS)).head().error
    assert (error is None) if bad is None else bad in error


@pytest.mark.parametrize(
    ("offsets", "stored", "bad"),
    [
        ([0, 1, 2], None, None),
        ([5, 6], None, None),
        ([110, 111, 112], State.COMPLETED, None),
        ([111, 112], State.COMPLETED, "follow"),
        ([110, 112], State.COMPLETED, "contiguous"),
        ([110, 110, 112], State.COMPLETED, "contiguous"),
        ([110, 111], State.IN_PROGRESS, "in progress"),
    ],
)
def test_validate_new(spark, offsets, stored, bad):
    led = ledger(spark) if stored is None else ledger(spark, 100, 109, stored)
    error = R.validate_new(R.range_state(records(spark, offsets)), led).head().error
    assert (error is None) if bad is None else bad in error


def test_classify(spark):
    got = R.classify(records(spark, [98, 100, 109, 110]), ledger(spark, 100, 109)).orderBy("offset").collect()
    assert [r["class"] for r in got] == ["SKIP", "OLD", "OLD", "NEW"]
    assert {r["class"] for r in R.classify(records(spark, [1, 2]), ledger(spark)).collect()} == {"NEW"}


def test_start_offset(spark):
    led = spark.createDataFrame([(0, 5, 9, 2), (1, 5, 9, 1)], RANGES)
    parts = spark.createDataFrame([(0, 77), (1, 77), (2, 77)], "partition_id bigint, committed bigint")
    assert {r.partition_id: r.start_offset for r in R.start_offset(parts, led).collect()} == {0: 10, 1: 5, 2: 77}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 12), min_size=1, max_size=14), st.integers(0, 6), st.integers(0, 6))
def test_ranges_against_sets(spark, offsets, low, extra):
    high = low + extra
    r = R.range_state(records(spark, offsets)).head()
    assert (r.min_offset, r.max_offset, r.n, r.n_distinct) == (min(offsets), max(offsets), len(offsets), len(set(offsets)))
    covers = R.covers_full_range(R.range_state(records(spark, offsets)), ledger(spark, low, high)).head().covers
    assert covers == (sorted(offsets) == list(range(low, high + 1)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 20), st.integers(0, 8))
def test_overlaps(spark, sizes, low, extra):
    written, at = [], 0
    for k, n in enumerate(sizes):
        if k % 2 == 0:
            written.append((7, at, at + n - 1))
        at += n
    cols = "partition_id bigint, min_offset bigint, max_offset bigint"
    got = R.overlaps(spark.createDataFrame([(7, low, low + extra)], cols), spark.createDataFrame(written, cols)).count()
    want = any(a <= low + extra and b >= low and (a, b) != (low, low + extra) for _, a, b in written)
    assert (got > 0) == want
