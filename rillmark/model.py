"""Schemas, states and the canonical transaction stream over the events table."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A message's payload. Offsets and partitions never come from it.
WIRE = "transaction_id string, user_id string, product_id string, amount bigint, date timestamp"
TOPIC = "partition_id bigint, offset bigint, value string"
TRANSACTIONS = "date date, transaction_id string, user_id string, product_id string, amount bigint, partition_id bigint, offset bigint, write_time timestamp"
REPORTS = "date date, user_id string, product_id string, partition_id bigint, amount bigint, offset bigint, write_time timestamp"
RANGES = "partition_id bigint, min_offset bigint, max_offset bigint, state tinyint"

TRANSACTION_COLUMNS = ["date", "transaction_id", "user_id", "product_id", "amount", "partition_id", "offset"]
REPORT_KEY = ["date", "user_id", "product_id"]

#: Messages of a partition that a batch holds at most.
BATCH_SIZE = 1000


class State(IntEnum):
    """What is known of a partition's last range."""

    UNKNOWN = 0
    IN_PROGRESS = 1
    COMPLETED = 2


def state_name(state: Column) -> Column:
    """The state's name; raises for any other number."""
    out = None
    for s in State:
        out = F.when(state == s.value, s.name) if out is None else out.when(state == s.value, s.name)
    return out.otherwise(F.raise_error(F.concat(F.lit("no such state: "), state.cast("string"))))


@dataclass(frozen=True)
class RangeState:
    """An inclusive range of offsets and its state."""

    min_offset: int = 0
    max_offset: int = 0
    state: State = State.UNKNOWN

    @property
    def size(self) -> int:
        return self.max_offset - self.min_offset + 1


class Repository(Protocol):
    def push(self, transactions: DataFrame, ranges: DataFrame) -> None: ...


class OffsetLedger(Protocol):
    def get(self, partition: int) -> RangeState: ...

    def put(self, partition: int, state: RangeState, epoch: int | None = None) -> int: ...

    def claim(self, partition: int) -> int: ...


class Lease(Protocol):
    def acquire(self, partition: int) -> bool: ...

    def release(self, partition: int) -> None: ...


def with_offsets(df: DataFrame, partition: str, order: str, chunk: int = 1 << 16) -> DataFrame:
    """Adds offset: each row's place from 0 among the rows of its partition, by an integer order.

    Rows are numbered within chunks of the order's values, and chunks are numbered by a window over their
    counts, so no task has to sort a whole partition.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))
    sizes = cut.groupBy(partition, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(partition).orderBy("_chunk")) - F.col("_n")
    bases = sizes.select(partition, "_chunk", before.alias("_base"))
    numbered = cut.withColumn("_row", F.row_number().over(Window.partitionBy(partition, "_chunk").orderBy(order)))
    return numbered.join(bases, [partition, "_chunk"]).withColumn("offset", (F.col("_base") + F.col("_row") - 1).cast("long")).drop("_chunk", "_base", "_row")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as transactions without offsets: one scan, for what doesn't ask where a message lies."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    return events.select(
        "event_id",
        F.concat(F.lit("tx-"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("product_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        F.col("ts").cast("date").alias("date"),
        (F.col("event_id") % 3).cast("bigint").alias("partition_id"),
    )


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a partitioned transaction stream; offsets are contiguous from 0 in each partition."""
    return with_offsets(events(spark, sf_dir), "partition_id", "event_id").select(*TRANSACTION_COLUMNS)
