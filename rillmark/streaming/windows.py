"""Sums by windows of event time, with a watermark: how long late rows are waited for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rillmark.streaming.live import StreamTable


def tumbling(time: str, length: str) -> Column:
    return F.window(time, length)


def sliding(time: str, length: str, step: str) -> Column:
    return F.window(time, length, step)


def session(time: str, gap: str) -> Column:
    """Rows of a key that follow each other by less than gap; it ends gap after its last row."""
    return F.session_window(time, gap)


def sums(rows: DataFrame, time: str, window: Column, delay: str, keys: list[str], amount: str = "amount") -> DataFrame:
    """Rows and sums by window and keys: start, end, keys, rows, amount. Works on streams and tables.

    On a stream in append mode a window comes out, once, when the watermark (the latest event time of the batches before, less
    delay) has passed its end. A row of a window that came out already is dropped: it is late. Spark drops by the watermark of
    the batch before, so late means: its window ends at or before the latest time of all batches but this one and the last, less
    delay. Rows without a time are in no window.
    """
    marked = rows.where(F.col(time).isNotNull()).withWatermark(time, delay)
    found = marked.groupBy(window.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("amount"))
    return found.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "rows", "amount")


class Dropped(StreamingQueryListener):
    """Counts what streams drop as late, by query id. Spark adds up rows of one key and window of a task first, and counts these
    sums; rows of sessions are counted one by one."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.counts[str(event.progress.id)] = self.counts.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        """Nothing to count."""

    def onQueryTerminated(self, event) -> None:
        """The count stays."""


class WindowTable(StreamTable):
    """The windows of a stream that are final, by start, end and keys."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str]) -> None:
        super().__init__(spark, root, ["start", "end", *keys])

    def start(self, windows: DataFrame, available_now: bool = False) -> StreamingQuery:
        return self.run(windows, "append", available_now)
