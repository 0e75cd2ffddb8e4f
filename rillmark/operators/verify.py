"""Exactly-once checks: four invariants, and a comparison record by record."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["user_id", "product_id", "amount", "date"]


def totals(transactions: DataFrame) -> DataFrame:
    return transactions.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))


def invariants(transactions: DataFrame, reports: DataFrame, expected: DataFrame) -> DataFrame:
    """Four rows (check, actual, expected, ok): loss, double write, raw sum and double count.

    expected has the columns of totals().
    """
    raw = transactions.agg(F.count_distinct("transaction_id").alias("distinct_ids"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("amount"), F.lit(0)).alias("raw_sum"))
    rep = reports.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("report_sum"))
    none = F.lit(None).cast("bigint")

    def sided(df: DataFrame, actual: bool, **columns: str) -> DataFrame:
        rows = [F.struct(F.lit(n).alias("check"), (F.col(c).cast("bigint") if actual else none).alias("actual"), (none if actual else F.col(c).cast("bigint")).alias("expected")) for n, c in columns.items()]
        return df.select(F.inline(F.array(*rows)))

    # three rows' facts meet by the check's name
    facts = sided(raw, True, loss="distinct_ids", double_write="rows", raw_sum="raw_sum").union(sided(rep, True, double_count="report_sum"))
    facts = facts.union(sided(expected, False, loss="row_count", double_write="row_count", raw_sum="total", double_count="total"))
    return facts.groupBy("check").agg(F.max("actual").alias("actual"), F.max("expected").alias("expected")).withColumn("ok", F.col("actual") == F.col("expected"))


def compare(produced: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each transaction_id of either side: produced (boolean), copies, differs (of the first stored copy
    by partition and offset), and both sides' amounts.

    Copies are counted and the first one found by a partial aggregation before the join, so an id that is stored
    very often costs one row in the join.
    """
    first = F.min_by(F.struct(*FIELDS), F.struct("partition_id", "offset", *FIELDS))
    have = stored.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("copies"), first.alias("s"), F.sum("amount").alias("stored_amount"))
    want = produced.select("transaction_id", F.struct(*FIELDS).alias("p"))
    differs = F.lit(False)
    for f in FIELDS:
        differs = differs | ~F.col(f"p.{f}").eqNullSafe(F.col(f"s.{f}"))
    return want.join(have, "transaction_id", "full_outer").select(
        "transaction_id",
        F.col("p").isNotNull().alias("produced"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.when(F.col("p").isNotNull() & F.col("s").isNotNull(), differs).otherwise(F.lit(False)).alias("differs"),
        F.col("p.amount").alias("produced_amount"),
        "stored_amount",
    )


def summary(compared: DataFrame) -> DataFrame:
    """One row of verdicts. Duplicates count every further copy, of unexpected ids as well."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    gone = F.col("produced") & (F.col("copies") == 0)
    return compared.agg(
        n(gone).alias("missing"),
        n(F.greatest(F.col("copies") - 1, F.lit(0))).alias("duplicates"),
        n(~F.col("produced")).alias("unexpected"),
        n(F.col("differs")).alias("corrupted"),
        n(F.col("produced_amount")).alias("produced_sum"),
        n(F.col("stored_amount")).alias("stored_sum"),
        F.min(F.when(gone, F.col("transaction_id"))).alias("missing_min"),
        F.max(F.when(gone, F.col("transaction_id"))).alias("missing_max"),
    )


def missing(produced: DataFrame, stored: DataFrame) -> DataFrame:
    return produced.join(stored.select("transaction_id"), "transaction_id", "left_anti").select("transaction_id")


def unexpected(produced: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(produced.select("transaction_id"), "transaction_id", "left_anti").select("transaction_id").distinct()


def duplicates(stored: DataFrame) -> DataFrame:
    return stored.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def field_diff(produced: DataFrame, stored: DataFrame) -> DataFrame:
    return compare(produced, stored).where("differs").select("transaction_id", "produced_amount", "stored_amount")


def examples(df: DataFrame, n: int = 10) -> DataFrame:
    """The first few ids, in order: a report's sample."""
    return df.select("transaction_id").orderBy("transaction_id").limit(n)


def scalar(make: Callable[[], DataFrame], tries: int = 5, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The one value of make()'s one row; a query that fails is made and run again."""
    for attempt in range(1, tries + 1):
        try:
            return make().head()[0]
        except Exception:
            if attempt == tries:
                raise
            sleep(pause)


def wait_for_distinct(stored: Callable[[], DataFrame], want: int, timeout: float = 360.0, pause: float = 2.0, settle: float = 2.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Waits until what is stored has want distinct ids or more, and a little longer, so that writes beyond it show. Returns
    how many there are then."""
    until = clock() + timeout
    count = lambda: scalar(lambda: stored().agg(F.count_distinct("transaction_id")), sleep=sleep)
    while (have := count()) < want:
        if clock() > until:
            raise TimeoutError(f"{have} of {want} transactions after {timeout} s")
        sleep(pause)
    sleep(settle)
    return count()
