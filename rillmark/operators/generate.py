"""Synthetic transactions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USERS = [f"user{i}" for i in range(1, 6)]
PRODUCTS = [f"product{i}" for i in range(1, 4)]


def _pick(values: list[str], seed: int):
    return F.element_at(F.array(*map(F.lit, values)), F.floor(F.rand(seed) * len(values)).cast("int") + 1)


def _id(seed: int):
    return F.sha2(F.concat_ws("-", F.lit(seed).cast("string"), F.col("id").cast("string")), 256).substr(1, 32)


def dataset(spark: SparkSession, n: int, seed: int = 1, day: date = date(2025, 3, 1)) -> DataFrame:
    """n transactions of 1 to 500 with distinct ids."""
    return spark.range(n).select(
        F.lit(day).alias("date"), _id(seed).alias("transaction_id"), _pick(USERS, seed + 1).alias("user_id"), _pick(PRODUCTS, seed + 2).alias("product_id"), (F.floor(F.rand(seed + 3) * 500) + 1).cast("bigint").alias("amount")
    )


def distribution(spark: SparkSession, total: int, most: int, users: list[str] = USERS, products: list[str] = PRODUCTS, day: date = date(2025, 3, 1), seed: int = 1) -> DataFrame:
    """Transactions of 0 to most that add up to exactly total.

    More are drawn than are needed; a running sum ends them, and the one that reaches the total is cut. The sum
    runs within chunks and over the chunks' sums, so that no single task sees all rows. If the draws don't
    suffice, which is very unlikely, one last row takes the rest in parts of most.
    """
    if total <= 0 or most <= 0:
        return spark.range(0).select(F.lit(day).alias("date"), F.lit("").alias("transaction_id"), F.lit("").alias("user_id"), F.lit("").alias("product_id"), F.lit(0).cast("bigint").alias("amount"))
    need = int(total / most * 2 * 1.1) + 200
    drawn = spark.range(need).select("id", F.floor(F.rand(seed) * (most + 1)).cast("bigint").alias("a"), F.floor(F.col("id") / 4096).alias("chunk"))
    sums = drawn.groupBy("chunk").agg(F.sum("a").alias("s"))
    base = sums.select("chunk", (F.sum("s").over(Window.orderBy("chunk")) - F.col("s")).alias("base"))
    run = drawn.withColumn("r", F.sum("a").over(Window.partitionBy("chunk").orderBy("id"))).join(base, "chunk").withColumn("before", F.col("base") + F.col("r") - F.col("a"))
    kept = run.where(F.col("before") < total).select("id", F.least(F.col("a"), F.lit(total) - F.col("before")).alias("amount"))
    short = drawn.agg(F.greatest(F.lit(total) - F.sum("a"), F.lit(0)).alias("left")).where(F.col("left") > 0)
    parts = short.select(F.explode(F.sequence(F.lit(0), F.ceil(F.col("left") / most) - 1)).alias("k"), "left")
    rest = parts.select((F.lit(need) + F.col("k")).alias("id"), F.least(F.lit(most), F.col("left") - F.col("k") * most).cast("bigint").alias("amount"))
    return kept.union(rest).select(F.lit(day).alias("date"), _id(seed).alias("transaction_id"), _pick(users, seed + 1).alias("user_id"), _pick(products, seed + 2).alias("product_id"), F.col("amount").cast("bigint").alias("amount"))


def history(spark: SparkSession, first: date, last: date, total: int, per_pass: int = 1_000_000, most: int = 500, seed: int = 1) -> DataFrame:
    """Passes over the days from first up to, not including, last, each of per_pass a day, until total is reached; the last
    one takes what is left. Adds pass, from 0; transaction_id is distinct over all passes.

    Passes are drawn at once: each has a running sum of its own, so nothing waits for the pass before.
    """
    each = days(spark, first, last)
    n = max(0, (last - first).days)
    if total <= 0 or per_pass <= 0 or most <= 0 or not n:
        return distribution(spark, 0, 1).withColumn("pass", F.lit(0).cast("bigint"))
    share = F.least(F.lit(per_pass), F.lit(total) - F.col("slot") * per_pass)
    slots = spark.range(-(-total // per_pass)).select(F.col("id").alias("slot")).withColumn("share", share.cast("bigint"))
    numbered = each.select("date", F.datediff("date", F.lit(first)).cast("bigint").alias("day"))
    slots = slots.withColumn("day", F.col("slot") % n).join(F.broadcast(numbered), "day")
    # as many draws as make the share all but certain; a share that the draws don't reach is topped up by their last
    need = int(per_pass / most * 2 * 1.1) + 200
    drawn = slots.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(need - 1)))).withColumn("a", F.floor(F.rand(seed) * (most + 1)).cast("bigint"))
    run = Window.partitionBy("slot").orderBy("k")
    drawn = drawn.withColumn("before", F.sum("a").over(run) - F.col("a"))
    kept = drawn.where(F.col("before") < F.col("share")).withColumn("last", F.col("k") == need - 1)
    left = F.col("share") - F.col("before")
    rows = kept.withColumn("amounts", F.when(F.col("last") & (left > most), F.transform(F.sequence(F.lit(0).cast("bigint"), F.ceil(left / most) - 1), lambda j: F.least(F.lit(most).cast("bigint"), left - j * most))).otherwise(F.array(F.least("a", left))))
    rows = rows.select("date", "slot", "k", F.posexplode("amounts").alias("j", "amount"))
    name = F.sha2(F.concat_ws("-", F.lit(seed), "slot", "k", "j"), 256).substr(1, 32)
    return rows.select("date", name.alias("transaction_id"), _pick(USERS, seed + 1).alias("user_id"), _pick(PRODUCTS, seed + 2).alias("product_id"), F.col("amount").cast("bigint").alias("amount"), F.floor(F.col("slot") / n).alias("pass"))


def days(spark: SparkSession, first: date, last: date) -> DataFrame:
    """The days from first up to, not including, last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("date")).where(F.col("date") < F.lit(last))
