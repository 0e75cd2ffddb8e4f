"""The 17-byte state record, insert tokens and shard routing."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillmark.model import RangeState, State

#: Big-endian: least and greatest offset as unsigned 64-bit integers, and the state as a byte.
RECORD = struct.Struct(">QQB")


def to_bytes(state: RangeState) -> bytes:
    return RECORD.pack(state.min_offset, state.max_offset, int(state.state))


def from_bytes(data: bytes | None) -> RangeState:
    """No record is the unknown state; one of fewer than 17 bytes is an error."""
    if data is None:
        return RangeState()
    if len(data) < RECORD.size:
        raise ValueError(f"a state record has {RECORD.size} bytes, not {len(data)}")
    low, high, state = RECORD.unpack_from(data)
    return RangeState(low, high, State(state))


def record(low: Column, high: Column, state: Column) -> Column:
    """The record as a binary column."""
    wide = lambda c, n: F.lpad(F.hex(c.cast("bigint")), n, "0")
    return F.unhex(F.concat(wide(low, 16), wide(high, 16), wide(state, 2)))


def unrecord(data: Column) -> Column:
    """min_offset, max_offset and state of a binary record, as a struct; fails for fewer than 17 bytes."""
    part = lambda a, n: F.conv(F.hex(F.substring(data, a, n)), 16, 10).cast("bigint")
    whole = F.struct(part(1, 8).alias("min_offset"), part(9, 8).alias("max_offset"), part(17, 1).cast("tinyint").alias("state"))
    return F.when(F.length(data) >= RECORD.size, whole).when(data.isNotNull(), F.raise_error(F.lit("a state record has 17 bytes")))


def insert_token(partition: Column, low: Column, high: Column) -> Column:
    """The name of a range's write. The same range has the same name, so writing it again changes nothing."""
    return F.format_string("transactions-insert-%d-%d-%d", partition.cast("bigint"), low.cast("bigint"), high.cast("bigint"))


def shard(partition: Column, shards: int = 2) -> Column:
    """The shard of a partition. All rows of a partition have one shard."""
    return F.pmod(F.xxhash64(partition), F.lit(shards)).cast("int")


def same_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)
