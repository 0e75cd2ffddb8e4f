"""Registered queries of joins by order and range, and of gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.model import BATCH_SIZE, canonical, with_offsets
from rillmark.operators import islands, joins
from rillmark.plans.catalog import batches, query

#: Microseconds of a chunk of the as-of join.
HOURS = 12 * 3_600_000_000


@query(
    """, timed AS (SELECT tx.*, epoch_us(e.ts) AS time FROM tx JOIN events e ON e.event_id = tx.event_id),
history AS (SELECT partition_id, min("offset") AS stored_min, max("offset") AS stored_max, max(time) AS time FROM timed GROUP BY partition_id, floor("offset" / 1000))
SELECT t.partition_id, t."offset", h.stored_min, h.stored_max, h.time AS matched_time FROM timed t ASOF LEFT JOIN history h ON t.partition_id = h.partition_id AND t.time >= h.time"""
)
def ledger_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each message, the last range of its partition that was complete when it came."""
    read = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 3).cast("bigint").alias("partition_id"), F.unix_micros(F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))).alias("time"))
    timed = with_offsets(read, "partition_id", "event_id").select("partition_id", "offset", "time")
    ranges = timed.groupBy("partition_id", F.floor(F.col("offset") / BATCH_SIZE).alias("batch"))
    history = ranges.agg(F.min("offset").alias("stored_min"), F.max("offset").alias("stored_max"), F.max("time").alias("time")).drop("batch")
    return joins.asof(timed, history, ["partition_id"], "time", HOURS).drop("time")


@query(
    """SELECT a.partition_id, a.batch, a.min_offset, a.max_offset, w.batch AS written_batch, w.min_offset AS written_min, w.max_offset AS written_max
       FROM (SELECT partition_id, batch, min_offset + 250 AS min_offset, max_offset + 250 + 1500 * (batch % 3) AS max_offset FROM ranges) a
       JOIN ranges w ON a.partition_id = w.partition_id AND w.min_offset <= a.max_offset AND w.max_offset >= a.min_offset"""
)
def range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a moved range, some of them longer, and a written one that share an offset."""
    written = batches(spark, sf_dir).select("partition_id", "batch", "min_offset", "max_offset")
    moved = written.withColumns({"min_offset": F.col("min_offset") + 250, "max_offset": F.col("max_offset") + 250 + 1500 * (F.col("batch") % 3)})
    pairs = joins.overlapping(moved, written, ["partition_id"])
    return pairs.select("partition_id", "left.batch", "left.min_offset", "left.max_offset", F.col("right.batch").alias("written_batch"), F.col("right.min_offset").alias("written_min"), F.col("right.max_offset").alias("written_max"))


_LOST = """, kept AS (SELECT partition_id, "offset" AS o FROM tx WHERE floor("offset" / 37) % 5 <> 3)
"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream after losses of 37 offsets in a row."""
    return canonical(spark, sf_dir).where(F.floor(F.col("offset") / 37) % 5 != 3).select("partition_id", "offset")


@query(
    _LOST
    + """SELECT partition_id, min(o) AS min_offset, max(o) AS max_offset, count(*) AS n
         FROM (SELECT partition_id, o, o - row_number() OVER (PARTITION BY partition_id ORDER BY o) AS run FROM kept) q GROUP BY partition_id, run"""
)
def offset_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.islands(_kept(spark, sf_dir), ["partition_id"])


@query(
    _LOST
    + """SELECT partition_id, o + 1 AS min_offset, ahead - 1 AS max_offset, ahead - o - 1 AS n
         FROM (SELECT partition_id, o, lead(o) OVER (PARTITION BY partition_id ORDER BY o) AS ahead FROM kept) q WHERE ahead > o + 1"""
)
def lost_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.gaps(_kept(spark, sf_dir), ["partition_id"])
