"""The offset ledger: a 17-byte state record a partition, taken over by compare and swap."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from rillmark.functions.state import from_bytes, to_bytes
from rillmark.model import RANGES, RangeState, State
from rillmark.workspace import Files

#: Partitions whose records are read or written at once.
WIDTH = 16


class Fenced(RuntimeError):
    """Another owner has written since."""


def each(f: Callable, items: list) -> list:
    """f of all items, WIDTH at a time: file operations wait for the store, not for the driver."""
    if len(items) < 2:
        return [f(x) for x in items]
    with ThreadPoolExecutor(min(WIDTH, len(items))) as pool:
        return list(pool.map(f, items))


class FileLedger:
    """Records <root>/<partition>/<number>; the greatest number counts.

    A record is written beside its place and renamed to the next number, which fails if that number is there: of two
    writers that have seen the same record one is refused, so nothing can come between a check and its write. The
    number is the owner's epoch. claim() writes the record once more, whereupon all older epochs are refused.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark)

    def _numbers(self, partition: int) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.root}/{partition}") if n.isdigit())

    def epoch(self, partition: int) -> int:
        return max(self._numbers(partition), default=0)

    def get(self, partition: int) -> RangeState:
        while True:
            number = self.epoch(partition)
            data = self.files.read(f"{self.root}/{partition}/{number:020d}") if number else None
            # a record that was replaced meanwhile is gone: then there is a newer one
            if data is not None or not number:
                return from_bytes(data)

    def put(self, partition: int, state: RangeState, epoch: int | None = None) -> int:
        """Writes the state and returns the new epoch. With an epoch, only if nobody has written since it."""
        if state.min_offset > state.max_offset:
            raise ValueError(f"partition {partition}: {state}")
        return self._swap(partition, to_bytes(state), self.epoch(partition) if epoch is None else epoch)

    def _swap(self, partition: int, data: bytes, seen: int) -> int:
        # older records are deleted, so a number that is behind would be free again: it is held against the greatest
        if seen < (last := self.epoch(partition)) or not self.files.create_whole(f"{self.root}/{partition}/{seen + 1:020d}", data):
            raise Fenced(f"partition {partition}: epoch {seen} is older than {max(last, seen + 1)}")
        for n in self._numbers(partition):
            if n < seen:  # the last but one stays for readers that are about to open it
                self.files.delete(f"{self.root}/{partition}/{n:020d}")
        return seen + 1

    def claim(self, partition: int) -> int:
        """Takes the partition for a new owner, and returns its epoch."""
        while True:
            seen = self.epoch(partition)
            try:
                return self._swap(partition, to_bytes(self.get(partition)), seen)
            except Fenced:
                continue

    def partitions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(self.root) if n.isdigit())

    def frame(self, partitions: list[int] | None = None) -> DataFrame:
        """The ledger, or some partitions of it, as (partition_id, min_offset, max_offset, state)."""
        wanted = self.partitions() if partitions is None else partitions
        states = zip(wanted, each(self.get, wanted), strict=True)
        # a claim without any range is no record of one
        rows = [(p, s.min_offset, s.max_offset, int(s.state)) for p, s in states if s.state is not State.UNKNOWN]
        return self.spark.createDataFrame(rows, RANGES)

    def clear(self) -> None:
        self.files.delete(self.root)


def start_offsets(ledger: FileLedger, committed: dict[int, int]) -> dict[int, int]:
    """Where each partition is to be read from: see operators.ranges.start_offset."""
    wanted = sorted({*committed, *ledger.partitions()})
    states = dict(zip(wanted, each(ledger.get, wanted), strict=True))
    return {p: {State.COMPLETED: s.max_offset + 1, State.IN_PROGRESS: s.min_offset}.get(s.state, committed.get(p, 0)) for p, s in states.items()}
