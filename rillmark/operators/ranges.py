"""Offset ranges as DataFrame operations.

A ledger is a DataFrame (partition_id, min_offset, max_offset, state), a row for each partition; a
partition without one is unknown. It has a row for each topic partition, so it is broadcast only below a
checked number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.model import State
from rillmark.operators.joins import overlapping

SKIP, OLD, NEW = "SKIP", "OLD", "NEW"
#: Ledger rows up to which the ledger is broadcast.
BROADCAST_ROWS = 100_000


def _with_ledger(df: DataFrame, ledger: DataFrame) -> DataFrame:
    stored = ledger.select("partition_id", F.col("min_offset").alias("stored_min"), F.col("max_offset").alias("stored_max"), F.col("state").alias("stored_state"))
    # one row over the bound tells that it is larger, without counting it
    few = stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = df.join(F.broadcast(stored) if few else stored, "partition_id", "left")
    return joined.withColumn("stored_state", F.coalesce("stored_state", F.lit(State.UNKNOWN.value)).cast("tinyint"))


def classify(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds class: SKIP below the stored range, OLD within it, NEW beyond it or without one. Also the stored range."""
    o = F.col("offset")
    known = F.col("stored_state") != State.UNKNOWN.value
    kind = F.when(~known, NEW).when(o < F.col("stored_min"), SKIP).when(o <= F.col("stored_max"), OLD).otherwise(NEW)
    return _with_ledger(records, ledger).withColumn("class", kind)


def range_state(records: DataFrame, *keys: str) -> DataFrame:
    """The range of each group of records: min_offset, max_offset, n, n_distinct and state IN_PROGRESS.

    Distinct offsets are counted from the gaps between neighbours' values, so that a range with a repeat and a
    gap isn't taken for contiguous.
    """
    keys = keys or ("partition_id",)
    per_offset = records.groupBy(*keys, "offset").agg(F.count(F.lit(1)).alias("c"))
    return per_offset.groupBy(*keys).agg(
        F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.lit(State.IN_PROGRESS.value).cast("tinyint").alias("state")
    )


def _contiguous() -> Column:
    size = F.col("max_offset") - F.col("min_offset") + 1
    return (F.col("n") == size) & (F.col("n_distinct") == size)


def validate_old(ranges: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds error to ranges of replayed records: null, or why they can't be a part of the stored range.

    A contiguous part of it is fine.
    """
    inside = (F.col("min_offset") >= F.col("stored_min")) & (F.col("max_offset") <= F.col("stored_max"))
    error = F.when(~F.coalesce(inside, F.lit(False)), "not contained in the stored range").when(~_contiguous(), "not contiguous")
    return _with_ledger(ranges, ledger).withColumn("error", error)


def validate_new(ranges: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds error to ranges of new records: null, or why they can't follow the stored range.

    The first range of a partition may begin anywhere. After a range that isn't completed nothing new is taken.
    """
    known = F.col("stored_state") != State.UNKNOWN.value
    error = (
        F.when(known & (F.col("min_offset") != F.col("stored_max") + 1), "does not follow the stored range")
        .when(~_contiguous(), "not contiguous")
        .when(F.col("stored_state") == State.IN_PROGRESS.value, "the stored range is still in progress")
    )
    return _with_ledger(ranges, ledger).withColumn("error", error)


def merge_pending(pending: DataFrame, incoming: DataFrame) -> DataFrame:
    """Records of both, one for each partition and offset; a pending one goes before an incoming one.

    Rows come in no order; see in_order().
    """
    both = pending.withColumn("_source", F.lit(0)).unionByName(incoming.withColumn("_source", F.lit(1)))
    keep = [c for c in both.columns if c not in ("partition_id", "offset", "_source")]
    first = F.min_by(F.struct(*keep), F.struct("_source", *keep)) if keep else None
    if first is None:
        return both.select("partition_id", "offset").distinct()
    merged = both.groupBy("partition_id", "offset").agg(first.alias("_r"))
    return merged.select("partition_id", "offset", *[F.col(f"_r.{c}").alias(c) for c in keep]).select(*pending.columns)


def in_order(records: DataFrame) -> DataFrame:
    """The records by partition and offset: ranges of them, each sorted, over as many tasks as a shuffle has partitions."""
    return records.orderBy("partition_id", "offset")


def covers_full_range(ranges: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds covers: whether the records are each offset of the stored range, once."""
    whole = (F.col("min_offset") == F.col("stored_min")) & (F.col("max_offset") == F.col("stored_max")) & _contiguous()
    return _with_ledger(ranges, ledger).withColumn("covers", F.coalesce(whole, F.lit(False)))


def accumulate(pending: DataFrame, incoming: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records held now, partitions with covers): replayed parts of ranges in progress, gathered until whole."""
    held = merge_pending(pending, incoming)
    return held, covers_full_range(range_state(held), ledger)


def start_offset(partitions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds start_offset to (partition_id, committed): after a completed range, at the beginning of one in
    progress, else where the broker's commit says."""
    s = F.col("stored_state")
    at = F.when(s == State.COMPLETED.value, F.col("stored_max") + 1).when(s == State.IN_PROGRESS.value, F.col("stored_min")).otherwise(F.col("committed"))
    return _with_ledger(partitions, ledger).withColumn("start_offset", at)


def latest(history: DataFrame, order: str = "seq") -> DataFrame:
    """The last state of each partition of a ledger's history."""
    last = F.max_by(F.struct("min_offset", "max_offset", "state"), F.col(order))
    return history.groupBy("partition_id").agg(last.alias("r")).select("partition_id", "r.min_offset", "r.max_offset", "r.state")


def overlaps(ranges: DataFrame, written: DataFrame) -> DataFrame:
    """Ranges that share an offset with a written range of another extent: (partition_id, min_offset, max_offset,
    written_min, written_max), with the least of these. Both have partition_id, min_offset, max_offset."""
    cols = ["partition_id", "min_offset", "max_offset"]
    pairs = overlapping(ranges.select(*cols), written.select(*cols), ["partition_id"])
    other = (F.col("left.min_offset") != F.col("right.min_offset")) | (F.col("left.max_offset") != F.col("right.max_offset"))
    least = pairs.where(other).groupBy("partition_id", "left.min_offset", "left.max_offset").agg(F.min("right").alias("w"))
    return least.select(*cols, F.col("w.min_offset").alias("written_min"), F.col("w.max_offset").alias("written_max"))
