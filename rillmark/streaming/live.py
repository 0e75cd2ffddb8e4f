"""The report as a stream: sums are kept in state, and each batch writes the keys that it has changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillmark.model import REPORT_KEY
from rillmark.operators import reports
from rillmark.streaming.keyed import KeyedTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, on the executors' disks, not in the JVM's heap. A query takes
    its settings when it is started; the session has its own ones again afterwards."""
    wanted = {_PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", **settings}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _nothing(step: str) -> None:
    """Called at each step of a batch; tests put faults here."""


class StreamTable:
    """The table that a stateful stream gives: <root>/table holds its rows by key, <root>/checkpoint its progress and state. They
    belong together.

    A crash before a batch is committed leaves the old state: Spark runs the same batch again from it, and the table takes each
    batch once.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], at: Callable[[str], None] = _nothing) -> None:
        self.spark, self.checkpoint, self.at = spark, f"{root.rstrip('/')}/checkpoint", at
        self.table = KeyedTable(spark, f"{root.rstrip('/')}/table", key)

    def run(self, result: DataFrame, mode: str, available_now: bool = False) -> StreamingQuery:
        """Starts the stream, or goes on where it was. mode: `update` for keys that change, `append` for keys that are final when
        they come. available_now ends when what there is has been read."""
        writer = result.writeStream.outputMode(mode).foreachBatch(self._take).option("checkpointLocation", self.checkpoint)
        with rocksdb(self.spark):
            return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="0 seconds")).start()

    def _take(self, rows: DataFrame, batch: int) -> None:
        self.at("before write")
        self.table.put(rows, batch)
        self.at("after write")

    def rows(self) -> DataFrame | None:
        """What has come so far, a row a key; None before the first batch."""
        return self.table.rows()


class LiveReport(StreamTable):
    """The merged report of a stream of transactions, kept up to date batch by batch.

    State holds a row for each key of the report, whatever the number of transactions. A batch in update mode gives the keys it
    has changed with their new sums, and only those are written.
    """

    def __init__(self, spark: SparkSession, root: str, at: Callable[[str], None] = _nothing) -> None:
        super().__init__(spark, root, REPORT_KEY, at)

    def start(self, transactions: DataFrame, available_now: bool = False) -> StreamingQuery:
        return self.run(reports.merged(transactions), "update", available_now)

    def report(self) -> DataFrame | None:
        """The report by date, user_id and product_id."""
        return self.rows()
