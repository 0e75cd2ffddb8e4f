"""Joins by order and range, islands and gaps, against plain loops; chunks change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from rillmark.operators import islands, joins


@pytest.fixture(scope="module")
def r():
    return random.Random(8)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_asof(spark, r, chunk):
    left = [(r.choice([1, 2, 3]), r.randrange(-20, 60), i) for i in range(80)] + [(1, None, 900), (None, 5, 901), (4, 5, 902)]
    right = [(r.choice([1, 2]), r.randrange(-20, 60), f"v{i % 9}") for i in range(25)] + [(1, 7, "a"), (1, 7, "b"), (None, 1, "x"), (2, None, "y")]
    got = joins.asof(spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, v string"), ["k"], "t", chunk).collect()
    want = {}
    for k, t, i in left:
        before = [(b, v) for a, b, v in right if k is not None and a == k and t is not None and b is not None and b <= t]
        want[i] = max(before) if before else (None, None)
    assert {x.i: (x.matched_t, x.v) for x in got} == want and len(got) == len(left)


def test_asof_of_a_hot_key_is_many_tasks(spark):
    left = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([(1, -5, "first")], "k int, t bigint, v string")
    got = joins.asof(left, right, ["k"], "t", 1000)
    assert got.where("v = 'first'").count() == 20_000
    # the window that orders rows is by chunk, not by key alone
    assert "_chunk" in got._jdf.queryExecution().optimizedPlan().toString().split("last(_right")[1].split("]")[0]
    with pytest.raises(ValueError, match="both sides"):
        joins.asof(left.withColumn("v", F.lit(1)), right, ["k"], "t", 10)


def ranges(r, n, longest):
    return [(r.choice([1, 2]), a := r.randrange(-50, 200), a + r.randrange(0, longest), i) for i in range(n)]


@pytest.mark.parametrize("longest", [1, 5, 150])
def test_overlapping(spark, r, longest):
    schema = "k int, min_offset bigint, max_offset bigint, i int"
    a, b = ranges(r, 40, longest) + [(1, -1000, 10**12, 90), (1, 5, 4, 91), (None, 0, 9, 92), (2, None, 9, 93)], ranges(r, 40, 12) + [(2, 3, 3, 90), (1, 0, 2**40, 91), (1, 0, 2**40, 91)]
    got = joins.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"]).select("k", "left.i", F.col("right.i").alias("j")).collect()
    sane = lambda rows: [x for x in rows if None not in x and x[1] <= x[2]]
    want = [(x[0], x[3], y[3]) for x in sane(a) for y in sane(b) if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(map(tuple, got)) == sorted(want) and want
    none = spark.createDataFrame([], schema)
    assert joins.overlapping(none, none, ["k"]).collect() == []


def test_a_long_range_is_few_rows(spark):
    schema = "k int, min_offset bigint, max_offset bigint"
    plan = joins.overlapping(spark.createDataFrame([(1, 0, 2**40)], schema), spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("min_offset"), F.col("id").alias("max_offset")), ["k"])
    assert plan.count() == 100
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "CartesianProduct" not in text


def plain_islands(rows):
    out = []
    for k in {k for k, o in rows if o is not None}:
        offsets = sorted({o for j, o in rows if j == k and o is not None})
        start = last = offsets[0]
        for o in [*offsets[1:], None]:
            if o is None or o != last + 1:
                out.append((k, start, last, last - start + 1))
                start = o
            last = o
    return out


@pytest.mark.parametrize("chunk", [1, 2, 5, 64, 1 << 16])
@pytest.mark.parametrize("share", [0.2, 0.9])
def test_islands_and_gaps(spark, r, chunk, share):
    rows = [(k, o) for k in (1, 2, None) for o in range(-20, 130) if r.random() < share]
    rows += [(1, 500), (1, 500), (3, 7), (1, None), (2, 64), (2, 65)]
    df = spark.createDataFrame(rows, "k int, offset bigint")
    want = plain_islands(rows)
    assert sorted(map(str, map(tuple, islands.islands(df, ["k"], chunk=chunk).collect()))) == sorted(map(str, want))
    lost = []
    for k in {w[0] for w in want}:
        mine = sorted(w[1:3] for w in want if w[0] == k)
        lost += [(k, b + 1, c - 1, c - b - 1) for (_, b), (c, _) in zip(mine, mine[1:])]
    assert sorted(map(str, map(tuple, islands.gaps(df, ["k"], chunk=chunk).collect()))) == sorted(map(str, lost))


def test_empty(spark):
    df = spark.createDataFrame([], "k int, offset bigint")
    assert islands.islands(df, ["k"]).collect() == islands.gaps(df, ["k"]).collect() == []
