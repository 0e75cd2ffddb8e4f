"""An ingestion job put together from settings."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from rillmark.config import Settings
from rillmark.streaming.ingest import Ingest
from rillmark.streaming.lease import FileLease
from rillmark.streaming.ledger import FileLedger
from rillmark.streaming.sink import TokenSink


def build(spark: SparkSession, settings: Settings) -> Ingest:
    """The job of one owner; without leases= it has none, and without owner= it gets a name of its own."""
    for name in ("ledger", "tables"):
        if not getattr(settings, name):
            raise ValueError(f"{name} is not set")
    lease = FileLease(spark, settings.leases, settings.owner or uuid.uuid4().hex, settings.lease_ttl) if settings.leases else None
    return Ingest(spark, FileLedger(spark, settings.ledger), TokenSink(spark, settings.tables, settings.stream), lease=lease, budget=settings.batch_budget, wait=settings.lease_wait)


def reset(spark: SparkSession, settings: Settings) -> None:
    """Clears ledger, leases and tables, and sees that nothing is left: an old COMPLETED record would make a fresh stream's
    messages be skipped."""
    job = build(spark, settings)
    job.ledger.clear()
    job.sink.files.delete(job.sink.base)
    if job.lease is not None:
        job.lease.clear()
    left = [path for path in (job.ledger.root, job.sink.base, *([job.lease.root] if job.lease else [])) if job.sink.files.names(path)]
    if left:
        raise OSError(f"still there: {left}")
