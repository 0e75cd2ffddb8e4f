"""Windows of event time: what is final, what is late, and what a restart changes."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from rillmark.sources import slices
from rillmark.streaming import windows as W

SCHEMA = "ts timestamp, k string, amount bigint"
DAY = dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


#: Slices of (minute, key, amount). With a delay of 10 minutes the watermark before slices 0 to 4 is -, 20, 50, 90 and 110; rows
#: are late by the one of the slice before.
ARRIVALS = [
    [(5, "a", 1), (30, "a", 2), (None, "a", 99)],
    [(8, "a", 4), (60, "b", 8)],
    [(9, "a", 16), (100, "a", 32), (55, "b", 64)],
    [(58, "b", 128), (25, "a", 256), (120, "a", 512)],
    [(10, "b", 1024), (121, "a", 2048)],
]


def stream(spark, tmp_path):
    rows = [(None if m is None else at(m), k, v, n) for n, part in enumerate(ARRIVALS) for m, k, v in part]
    slices.stage(spark.createDataFrame(rows, f"{SCHEMA}, slice bigint"), "slice", f"file://{tmp_path}/in")
    return slices.stream(spark, f"file://{tmp_path}/in", SCHEMA)


def minutes(c):
    return ((F.unix_seconds(c) - int(DAY.timestamp())) / 60).cast("int")


def plain(width, step):
    """(start, key): (rows, amount) of the windows that end by the last watermark, and how many (row, window) are late."""
    out, late, top = {}, 0, [max((m for m, _, _ in part if m is not None)) for part in ARRIVALS]
    for n, part in enumerate(ARRIVALS):
        mark = max(top[: n - 1]) - 10 if n > 1 else None
        for m, k, v in part:
            for start in [] if m is None else range(m // step * step - width + step, m // step * step + 1, step):
                if mark is not None and start + width <= mark:
                    late += 1
                    continue
                rows, amount = out.get((start, k), (0, 0))
                out[start, k] = rows + 1, amount + v
    return {(s, k): x for (s, k), x in out.items() if s + width <= max(top) - 10}, late


@pytest.mark.parametrize("width, step", [(20, 20), (40, 20), (60, 10)])
def test_windows(spark, tmp_path, width, step):
    source = stream(spark, tmp_path)
    window = W.tumbling("ts", f"{width} minutes") if width == step else W.sliding("ts", f"{width} minutes", f"{step} minutes")
    found, table, dropped = W.sums(source, "ts", window, "10 minutes", ["k"]), W.WindowTable(spark, f"file://{tmp_path}/out", ["k"]), W.Dropped()
    spark.streams.addListener(dropped)
    try:
        query = table.start(found, True)
        query.awaitTermination(120)
        want, late = plain(width, step)
        got = {(r.s, r.k): (r.rows, r.amount) for r in table.rows().select(minutes("start").alias("s"), "k", "rows", "amount").collect()}
        assert got == want and late > 0
        until = time.monotonic() + 20
        while dropped.counts.get(str(query.id), 0) != late and time.monotonic() < until:
            time.sleep(0.1)
        assert dropped.counts[str(query.id)] == late
    finally:
        spark.streams.removeListener(dropped)


def test_sessions(spark, tmp_path):
    table = W.WindowTable(spark, f"file://{tmp_path}/out", ["k"])
    table.start(W.sums(stream(spark, tmp_path), "ts", W.session("ts", "15 minutes"), "10 minutes", ["k"]), True).awaitTermination(120)
    got = {(r.s, r.e, r.k): (r.rows, r.amount) for r in table.rows().select(minutes("start").alias("s"), minutes("end").alias("e"), "k", "rows", "amount").collect()}
    # 9, a came when the watermark of the batch before was 20: its session ends at 24, so it joins the first one
    assert got[5, 24, "a"] == (3, 21) and got[30, 45, "a"] == (1, 2)
    assert got[55, 75, "b"][0] >= 2 and (10, 25, "b") not in got and (25, 40, "a") not in got


def test_of_a_table(spark):
    rows = [(at(m), k, v) for part in ARRIVALS for m, k, v in part if m is not None]
    got = W.sums(spark.createDataFrame(rows, SCHEMA), "ts", W.tumbling("ts", "20 minutes"), "10 minutes", ["k"])
    assert got.agg(F.sum("rows"), F.sum("amount")).head()[:] == (len(rows), sum(r[2] for r in rows))
