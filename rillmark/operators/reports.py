"""Sum and max reports: partials kept per write, merged when read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.model import REPORT_KEY


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    latest = [F.max(c).alias(c) for c in ("offset", "write_time") if c in df.columns]
    return df.groupBy(*keys).agg(F.sum("amount").alias("amount"), *latest)


def partials(transactions: DataFrame, *more_keys: str) -> DataFrame:
    """What one write adds to the report: by day, user, product and partition."""
    return _sums(transactions, *more_keys, *REPORT_KEY, "partition_id")


def merged(partial: DataFrame) -> DataFrame:
    """The report. Partials of partials are partials, so it may be merged again. It has no partition_id, which has no
    meaning once rows of several partitions are added up."""
    return _sums(partial, *REPORT_KEY)


def rollup(report: DataFrame, unit: str) -> DataFrame:
    """Sums by day, week or month: period (its first day), amount, rows."""
    return report.groupBy(F.to_date(F.date_trunc(unit, "date")).alias("period")).agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("rows"))
