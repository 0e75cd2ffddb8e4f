"""Ranges in progress as keyed state: replayed parts are kept until the range is whole, and a timer tells of one that never is."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillmark.model import State
from rillmark.operators.ranges import OLD

WHOLE, INCOMPLETE = "whole", "incomplete"
#: Rows of a block in state at most.
CHUNK = 4096


def joined(intervals: list[list[int]]) -> list[list[int]]:
    """Inclusive intervals in order, joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _runs(offsets: np.ndarray) -> list[list[int]]:
    """Inclusive intervals of distinct offsets."""
    o = np.sort(offsets)
    cuts = np.flatnonzero(np.diff(o) > 1)
    return [[int(a), int(b)] for a, b in zip(o[np.append(0, cuts + 1)], o[np.append(cuts, len(o) - 1)], strict=True)]


def _outside(offsets: np.ndarray, covered: list[list[int]]) -> np.ndarray:
    """Which offsets are in none of the intervals, which are in order."""
    if not covered:
        return np.ones(len(offsets), bool)
    low, high = np.array(covered, np.int64).T
    k = np.searchsorted(low, offsets, side="right") - 1
    return (k < 0) | (offsets > high[k])


def _blob(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


class _Parts(StatefulProcessor):
    """State of a range: its bounds and what is covered of it (as a few intervals), and the rows so far, a
    block of Arrow's stream format for each part (state that is read row by row takes many times as long).

    A row whose offset is covered is a repeat: the first one counts. When nothing is missing, all rows go out and only the mark
    that the range is whole stays, so that later repeats give nothing.
    """

    def __init__(self, columns: list[str], timeout_ms: int | None) -> None:
        self.columns, self.timeout = columns, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.range = handle.getValueState("range", "max_offset bigint, covered string, whole boolean")
        self.parts = handle.getListState("blocks", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        low, known = int(key[1]), self.range.get()
        high, covered, whole = (int(known[0]), json.loads(known[1]), bool(known[2])) if known is not None else (None, [], False)
        for part in rows:
            if high is None:
                high = int(part["stored_max"].iloc[0])
                if self.timeout is not None:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
            if whole:
                continue
            # equal offsets of one batch come in no order: the least row counts, so that a replay keeps the same
            if part["offset"].duplicated().any():
                part = part.sort_values(self.columns, kind="stable").drop_duplicates("offset")
            o = part["offset"].to_numpy()
            inside = part[(o >= low) & (o <= high) & _outside(o, covered)]
            if len(inside):
                self.parts.appendList([(_blob(inside[self.columns].iloc[a : a + CHUNK]),) for a in range(0, len(inside), CHUNK)])
                covered = joined([*covered, *_runs(inside["offset"].to_numpy())])
        done = whole or covered == [[low, high]]
        self.range.update((high, json.dumps(covered), done))
        if done and not whole:
            yield from self._all(int(key[0]), low, high)
            self.parts.clear()
            for t in list(self.handle.listTimers()) if self.timeout is not None else []:
                self.handle.deleteTimer(t)

    def _all(self, partition: int, low: int, high: int) -> Iterator[pd.DataFrame]:
        for row in self.parts.get():
            made = pa.ipc.open_stream(bytes(row[0])).read_pandas()
            made.insert(0, "partition_id", partition)
            yield made.assign(kind=WHOLE, min_offset=low, max_offset=high, missing=0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.range.get()
        if known is None or known[2]:
            return
        low, high = int(key[1]), int(known[0])
        missing = high - low + 1 - sum(b - a + 1 for a, b in json.loads(known[1]))
        row = {"partition_id": int(key[0]), **dict.fromkeys(self.columns), "kind": INCOMPLETE, "min_offset": low, "max_offset": high, "missing": missing}
        yield pd.DataFrame([row])

    def close(self) -> None:
        """Nothing is held outside state."""


def gather(classified: DataFrame, columns: list[str], timeout: float | None = None) -> DataFrame:
    """The rows of ranges in progress, once each range is whole; a stream in append mode (see live.rocksdb for its state).

    classified is a stream of records as operators.ranges.classify() gives them: OLD records of an IN_PROGRESS range are its parts,
    others are left out. Each range of a partition is a key, so its state is bounded by the range's size. Gives partition_id,
    columns (`offset` among them), kind, min_offset, max_offset, missing: a `whole` row for each offset of a range that has become
    whole, the first one that came of each offset; and an `incomplete` row, with the number of offsets that are missing, for a
    range that isn't whole `timeout` seconds after its first part. Its parts stay, and complete it if the rest comes later.

    With a timeout the stream looks at its timers again and again, so it has to be stopped: it doesn't end by itself under
    availableNow. Without one there are no timers.
    """
    if "offset" not in columns:
        raise ValueError("columns must have offset")
    parts = classified.where((F.col("class") == OLD) & (F.col("stored_state") == State.IN_PROGRESS.value))
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    keep = parts.select("partition_id", "stored_min", "stored_max", *columns)
    long, text = T.LongType(), T.StringType()
    out = T.StructType([T.StructField("partition_id", long), *[T.StructField(c, kinds[c]) for c in columns], T.StructField("kind", text), *[T.StructField(c, long) for c in ("min_offset", "max_offset", "missing")]])
    return keep.groupBy("partition_id", "stored_min").transformWithStateInPandas(statefulProcessor=_Parts(columns, None if timeout is None else int(timeout * 1000)), outputStructType=out, outputMode="Append", timeMode="None" if timeout is None else "ProcessingTime")
