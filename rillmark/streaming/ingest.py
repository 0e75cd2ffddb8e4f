"""Exactly-once ingestion of a topic: the body of foreachBatch, and drivers for whole runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillmark.functions.wire import decode
from rillmark.model import BATCH_SIZE, RangeState, State
from rillmark.operators import ranges as R
from rillmark.sources import topic
from rillmark.streaming.lease import FileLease
from rillmark.streaming.ledger import Fenced, FileLedger, each, start_offsets
from rillmark.streaming.sink import TokenSink

RETRIES, PAUSE = 3, 0.5
#: Seconds that a batch may take, and that it waits for a partition's lease.
BUDGET, WAIT = 60.0, 20.0


class InvalidRange(ValueError):
    """Offsets that can't be what they claim: a gap, a repeat, or a range that doesn't follow the stored one."""


class LeaseLost(RuntimeError):
    """A partition is another owner's, or the batch has taken longer than its leases hold."""


def transient(error: BaseException) -> bool:
    """Whether a write may succeed if it is tried again: failures of stores, executors and the JVM, but not messages that
    can't be read, rows that don't belong, or queries that make no sense."""
    if isinstance(error, AnalysisException):
        return False
    if isinstance(error, PySparkException | Py4JError):
        return not any(mark in str(error) for mark in ("MALFORMED_RECORD_IN_PARSING", "USER_RAISED_EXCEPTION"))
    return isinstance(error, OSError)


def _nothing(step: str) -> None:
    """Called at each step of a batch; tests put faults here."""


class Ingest:
    """Writes batches of a topic. Each range goes IN_PROGRESS, raw rows and partials, COMPLETED.

    All partitions of a batch are written by one job. A crash at any step is repaired by the replay: the ledger
    says what was begun, and the token makes writing it again change nothing.

    With a lease, a batch takes those of its partitions first and gives up if it can't get one within `wait` seconds, or
    takes longer than `budget` altogether; then it frees those that it holds. The first batch of a partition claims it in the
    ledger; should another owner claim it later, this one's next record is refused (Fenced), whatever its lease says.
    """

    def __init__(
        self,
        spark: SparkSession,
        ledger: FileLedger,
        sink: TokenSink,
        at: Callable[[str], None] = _nothing,
        sleep: Callable[[float], None] = time.sleep,
        lease: FileLease | None = None,
        budget: float = BUDGET,
        wait: float = WAIT,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self.spark, self.ledger, self.sink, self.at, self.sleep = spark, ledger, sink, at, sleep
        self.lease, self.budget, self.wait, self.clock = lease, budget, wait, clock
        self.epochs: dict[int, int] = {}
        self.until = float("inf")

    def batch(self, messages: DataFrame, batch_id: int = 0) -> None:
        messages = messages.persist()
        try:
            # a row for each partition of the batch
            partitions = sorted(r.partition_id for r in messages.select("partition_id").distinct().collect())
            if not partitions:
                return
            self._own(partitions)
            stored = self.ledger.frame(partitions)
            sorted_out = R.classify(messages, stored)
            found = R.range_state(sorted_out.where(F.col("class") != R.SKIP), "partition_id", "class")
            checked = R.validate_old(found.where(F.col("class") == R.OLD), stored).unionByName(R.validate_new(found.where(F.col("class") == R.NEW), stored))
            rows = checked.collect()
            olds, news = ({r.partition_id: r for r in rows if r["class"] == kind} for kind in (R.OLD, R.NEW))
            for r in olds.values():
                if r.error:
                    raise InvalidRange(f"partition {r.partition_id}: replayed range {r.min_offset}-{r.max_offset} {r.error}")
            settled, pieces = self._replays(sorted_out, stored, olds, news)
            for p, r in news.items():
                if r.error and not (p in settled and r.error == "the stored range is still in progress"):
                    raise InvalidRange(f"partition {p}: new range {r.min_offset}-{r.max_offset} {r.error}")
            # a range in progress is settled before anything follows it
            if settled:
                self._write(pieces, settled)
                self.sink.drop_pending(list(settled))
            if news:
                fresh = sorted_out.where(F.col("class") == R.NEW).select("partition_id", "offset", "value")
                self._write(decode(fresh), {p: RangeState(r.min_offset, r.max_offset) for p, r in news.items()})
        except LeaseLost:
            # others needn't wait until these leases end by themselves; what is written late is refused by its epoch
            each(self.lease.release, partitions)
            raise
        finally:
            messages.unpersist()

    def _own(self, partitions: list[int]) -> None:
        """Leases and epochs of the batch's partitions. A lease that was another's since is a new epoch."""
        self.until = self.clock() + self.budget
        if self.lease is not None:
            for p in partitions:
                held = self.lease.holder(p) == self.lease.owner
                if not self.lease.wait(p, self.wait, sleep=self.sleep):
                    raise LeaseLost(f"partition {p} is {self.lease.holder(p)}'s")
                if not held:
                    self.epochs.pop(p, None)
        fresh = [p for p in partitions if p not in self.epochs]
        self.epochs.update(zip(fresh, each(self.ledger.claim, fresh), strict=True))

    def _in_time(self) -> None:
        if self.lease is not None and self.clock() > self.until:
            raise LeaseLost(f"the batch has taken more than {self.budget} s")

    def _replays(self, sorted_out: DataFrame, stored: DataFrame, olds: dict, news: dict) -> tuple[dict[int, RangeState], DataFrame | None]:
        """Ranges in progress that the batch completes, and their rows. Parts are kept aside until they are whole. One job
        looks at all partitions, and one more keeps what is left."""
        begun = {p: r for p, r in olds.items() if r.stored_state == State.IN_PROGRESS.value}
        if not begun:
            return {}, None
        part = decode(sorted_out.where((F.col("class") == R.OLD) & F.col("partition_id").isin(list(begun))).select("partition_id", "offset", "value"))
        held = self.sink.pending(list(begun))
        part = part if held is None else R.merge_pending(held, part)
        whole = {r.partition_id for r in R.covers_full_range(R.range_state(part), stored).where("covers").collect()}
        left = [p for p in begun if p not in whole]
        early = next((p for p in left if p in news), None)
        if early is not None:
            raise InvalidRange(f"partition {early}: new records come before the range in progress is whole")
        if left:
            self.sink.keep_pending(part, left)
        settled = {p: RangeState(begun[p].stored_min, begun[p].stored_max) for p in begun if p in whole}
        return settled, part.where(F.col("partition_id").isin(list(settled))) if settled else None

    def _write(self, rows: DataFrame, ranges: dict[int, RangeState]) -> None:
        for attempt in range(1, RETRIES + 1):
            try:
                return self._write_once(rows, ranges)
            except Exception as e:
                if attempt == RETRIES or not transient(e):
                    raise
                self.sleep(attempt * PAUSE)

    def _write_once(self, rows: DataFrame, ranges: dict[int, RangeState]) -> None:
        self.at("before IN_PROGRESS")
        self._record(ranges, State.IN_PROGRESS)
        self.at("after IN_PROGRESS")
        self.sink.push(rows, self.spark.createDataFrame([(p, r.min_offset, r.max_offset) for p, r in ranges.items()], "partition_id bigint, min_offset bigint, max_offset bigint"))
        self.at("after write")
        self._record(ranges, State.COMPLETED)
        self.at("after COMPLETED")

    def _record(self, ranges: dict[int, RangeState], state: State) -> None:
        self._in_time()

        def put(p: int) -> None:
            try:
                self.epochs[p] = self.ledger.put(p, RangeState(ranges[p].min_offset, ranges[p].max_offset, state), self.epochs[p])
            except Fenced:
                self.epochs.pop(p)
                raise

        each(put, list(ranges))

    def start(self, root: str, checkpoint: str, most: int = BATCH_SIZE, available_now: bool = False, committed: dict[int, int] | None = None) -> StreamingQuery:
        """Starts ingestion of the topic log at root. Without a checkpoint it begins where the ledger says."""
        begin = start_offsets(self.ledger, committed or dict.fromkeys(topic.partitions(root), 0))
        writer = topic.stream(self.spark, root, begin, most).writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="0 seconds")).start()

    def catch_up(self, root: str, checkpoint: str, most: int = BATCH_SIZE, timeout: float = 600.0) -> None:
        """Ingests until the ledger has all that the topic holds now, then stops; gives up after timeout seconds in which
        the ledger hasn't changed."""
        ends = {p: topic.end_offset(root, p) for p in topic.partitions(root)}
        query = self.start(root, checkpoint, most)
        seen, until = None, 0.0
        try:
            while True:
                states = each(self.ledger.get, list(ends))
                if all(self._done(s, end) for s, end in zip(states, ends.values(), strict=True)):
                    break
                if states != seen:
                    seen, until = states, time.monotonic() + timeout
                if (error := query.exception()) is not None:
                    raise error
                if not query.isActive or time.monotonic() > until:
                    raise TimeoutError("the stream ended before it had caught up")
                time.sleep(0.1)
            query.processAllAvailable()
        finally:
            query.stop()

    def _done(self, s: RangeState, end: int) -> bool:
        return end == 0 or (s.state is State.COMPLETED and s.max_offset + 1 >= end)
