"""Registered queries of the stateful streams. Each reads the whole events table as slices that arrive one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.model import BATCH_SIZE, canonical, events
from rillmark.operators import ranges as R
from rillmark.plans.catalog import query
from rillmark.sources import slices
from rillmark.streaming import windows as W
from rillmark.streaming.gather import WHOLE, gather
from rillmark.streaming.live import LiveReport, StreamTable
from rillmark.workspace import new_path

#: Rows of a slice in each partition at most, and slices at least.
SLICE_ROWS, SLICES = 1 << 20, 6

_SEEN = "date date, transaction_id string, user_id string, product_id string, amount bigint, partition_id bigint, offset bigint"


def _count(spark: SparkSession, sf_dir: str) -> int:
    return events(spark, sf_dir).count()


class _Crash(RuntimeError):
    pass


@query('SELECT "date", user_id, product_id, CAST(sum(amount) AS BIGINT) AS amount, max("offset") AS "offset" FROM tx GROUP BY 1, 2, 3')
def report_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as a stream with its sums in state; the third batch crashes after its write, and a restart goes on from state."""
    root, left = new_path(spark, "live"), [3]
    rows = canonical(spark, sf_dir)
    last = rows.agg(F.max("offset")).head()[0] or 0
    per = max(1, min(SLICE_ROWS, -(-(last + 1) // SLICES)))
    slices.stage(rows.withColumn("slice", F.floor(F.col("offset") / per)), "slice", f"{root}/in", slices.files_of(3 * per))

    def crash(step: str) -> None:
        if step == "after write":
            left[0] -= 1
            if left[0] == 0:
                raise _Crash(step)

    try:
        LiveReport(spark, root, crash).start(slices.stream(spark, f"{root}/in", _SEEN), True).awaitTermination()
    except Exception as e:  # Spark wraps what the batch raised
        if left[0] or "_Crash" not in str(e):
            raise
    live = LiveReport(spark, root)
    live.start(slices.stream(spark, f"{root}/in", _SEEN), True).awaitTermination()
    return live.report()


@query("""SELECT partition_id, "offset", amount + CASE WHEN "offset" % 10 < 5 THEN 0 WHEN "offset" % 10 <= 8 THEN 1 ELSE 2 END AS amount,
          min("offset") OVER (PARTITION BY partition_id, floor("offset" / 1000)) AS min_offset, max("offset") OVER (PARTITION BY partition_id, floor("offset" / 1000)) AS max_offset FROM tx""")
def gather_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's range is in progress and comes again in three parts that overlap, one after the other: state gives each range
    once, whole, with the first row of each offset."""
    root = new_path(spark, "gather")
    rows = canonical(spark, sf_dir).select("partition_id", "offset", "amount").withColumn("batch", F.floor(F.col("offset") / BATCH_SIZE).cast("bigint"))
    stored = R.range_state(rows, "partition_id", "batch").select("partition_id", "batch", F.col("min_offset").alias("stored_min"), F.col("max_offset").alias("stored_max"), F.col("state").alias("stored_state"))
    known = rows.join(stored, ["partition_id", "batch"]).withColumn("class", F.lit(R.OLD))
    place = F.col("offset") % 10
    kinds = F.filter(F.array(*[F.when(p, F.lit(k)) for k, p in enumerate((place < 5, place.between(3, 8), place >= 7))]), lambda k: k.isNotNull())
    parts = known.withColumn("slice", F.explode(kinds)).withColumn("amount", F.col("amount") + F.col("slice"))
    # a part has six tenths of the rows at most
    slices.stage(parts, "slice", f"{root}/in", slices.files_of(_count(spark, sf_dir) * 6 // 10))
    schema = parts.drop("slice").schema
    table = StreamTable(spark, f"{root}/out", ["partition_id", "offset"])
    found = gather(slices.stream(spark, f"{root}/in", schema), ["offset", "amount"]).where(F.col("kind") == WHOLE)
    table.run(found, "append", True).awaitTermination()
    return table.rows().select("partition_id", "offset", "amount", "min_offset", "max_offset")


#: Some events arrive six hours late, others three days; a slice is what arrives in five days.
_ARRIVAL = """, seen AS (SELECT ts, event_type AS product_id, CAST(user_id AS VARCHAR) AS user_id, CAST(round(value * 100) AS BIGINT) AS amount,
  CAST(floor(epoch(ts + CASE WHEN event_id % 50 = 7 THEN INTERVAL 72 HOUR WHEN event_id % 10 = 3 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END) / 432000) AS BIGINT) AS slice FROM events),
arrived AS (SELECT *, dense_rank() OVER (ORDER BY slice) AS b FROM seen),
marks AS (SELECT b, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY b)) - INTERVAL 24 HOUR AS mark FROM arrived GROUP BY b),
late AS (SELECT arrived.*, marks.mark FROM arrived LEFT JOIN marks ON marks.b = arrived.b - 2),
final AS (SELECT max(mark) AS mark FROM marks)
"""


def _arriving(spark: SparkSession, sf_dir: str, root: str, latest: int = 72) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    hours = F.when(F.col("event_id") % 50 == 7, latest).when(F.col("event_id") % 10 == 3, 6).otherwise(0)
    # times without a zone are UTC, as a session's zone must not move windows
    seconds = F.unix_micros(F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))
    rows = read.select(
        F.timestamp_micros(seconds).alias("ts"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("product_id"), F.round(F.col("value") * 100).cast("bigint").alias("amount"), F.floor((seconds / 1e6 + hours * 3600) / 432000).cast("bigint").alias("slice")
    )
    slices.stage(rows, "slice", f"{root}/in", slices.files_of(_count(spark, sf_dir) // SLICES))
    return slices.stream(spark, f"{root}/in", "ts timestamp, user_id string, product_id string, amount bigint")


def _final(spark: SparkSession, root: str, windows: DataFrame, keys: list[str]) -> DataFrame:
    table = W.WindowTable(spark, f"{root}/out", keys)
    table.start(windows, True).awaitTermination()
    # UTC whatever the session's zone is
    plain = lambda c: F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(`{c}`))")
    return table.rows().select(plain("start").alias("start"), plain("end").alias("end"), *keys, "rows", "amount")


_WINDOW = """SELECT s AS "start", s + INTERVAL {length} HOUR AS "end", product_id, count(*) AS "rows", CAST(sum(amount) AS BIGINT) AS amount
FROM (SELECT *, time_bucket(INTERVAL {step} HOUR, ts) - INTERVAL {step} HOUR * k AS s FROM late, (SELECT unnest(generate_series(0, {length} // {step} - 1)) AS k) g) q, final
WHERE (q.mark IS NULL OR s + INTERVAL {length} HOUR > q.mark) AND s + INTERVAL {length} HOUR <= final.mark GROUP BY 1, 2, 3"""


@query(_ARRIVAL + _WINDOW.format(length=6, step=6))
def windows_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by six hours and product; rows that are more than a day late are dropped."""
    root = new_path(spark, "windows")
    found = W.sums(_arriving(spark, sf_dir, root), "ts", W.tumbling("ts", "6 hours"), "1 day", ["product_id"])
    return _final(spark, root, found, ["product_id"])


@query(_ARRIVAL + _WINDOW.format(length=24, step=8))
def windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by days that begin every eight hours."""
    root = new_path(spark, "windows")
    found = W.sums(_arriving(spark, sf_dir, root), "ts", W.sliding("ts", "24 hours", "8 hours"), "1 day", ["product_id"])
    return _final(spark, root, found, ["product_id"])


@query(
    _ARRIVAL.replace("INTERVAL 72 HOUR", "INTERVAL 12 HOUR")
    + """, steps AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
named AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM steps)
SELECT date_trunc('second', min(ts)) AS "start", date_trunc('second', max(ts) + INTERVAL 2 HOUR) AS "end", user_id, count(*) AS "rows", CAST(sum(amount) AS BIGINT) AS amount
FROM named GROUP BY user_id, n HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT mark FROM final)"""
)
def windows_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, which end after two hours without an event (whole seconds are shown). Nothing is later than the delay."""
    root = new_path(spark, "windows")
    found = W.sums(_arriving(spark, sf_dir, root, 12), "ts", W.session("ts", "2 hours"), "1 day", ["user_id"])
    return _final(spark, root, found, ["user_id"])
