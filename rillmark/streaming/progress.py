"""Progress of streaming queries in the log."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("rillmark.progress")


class ProgressLog(StreamingQueryListener):
    """Logs each batch's number, rows and milliseconds, and how a query ended."""

    def onQueryStarted(self, event) -> None:
        log.info("query %s started, run %s", event.id, event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        log.info("query %s batch %d: %d rows in %d ms", p.id, p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            log.error("query %s failed: %s", event.id, event.exception)
        else:
            log.info("query %s ended", event.id)


def watch(spark: SparkSession) -> ProgressLog:
    """Adds a ProgressLog to the session; spark.streams.removeListener() takes it away."""
    listener = ProgressLog()
    spark.streams.addListener(listener)
    return listener
