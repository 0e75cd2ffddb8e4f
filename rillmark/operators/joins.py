"""Joins by order and by range, in parts that no key can make large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, chunk: int) -> DataFrame:
    """Adds to each left row the last right row of its keys that isn't later: right's other columns, null where there is none.

    time is an integer column of both sides, cut into chunks of that length. In a chunk of a key both sides are put in one order,
    where each left row takes the right row before it; what a chunk begins with is the last right row of the chunks before, found
    among one row a chunk. So a key's rows are as many tasks as it has chunks. Of right rows of one time the greatest by its
    columns counts. Left rows without a time or with a null key have no match. Columns that both sides have besides must be
    renamed before.
    """
    rest, own = [c for c in right.columns if c not in (*keys, time)], left.columns
    clash = set(rest) & set(own)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    usable = lambda df: df.where(F.col(time).isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    cut = F.floor(F.col(time) / chunk)
    sent = usable(right).select(*keys, F.col(time).alias("_t"), cut.alias("_chunk"), F.struct(F.col(time).alias("_t"), *rest).alias("_right"))
    sides = left.select(F.struct(*own).alias("_left"), *keys, F.col(time).alias("_t"), cut.alias("_chunk"))
    both = sides.withColumn("_side", F.lit(1)).unionByName(sent.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_chunk").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    # one row a chunk that has right rows, and one that has left rows: the carry goes by chunks
    ends = sent.groupBy(*keys, "_chunk").agg(F.max("_right").alias("_end")).unionByName(sides.select(*keys, "_chunk").distinct(), allowMissingColumns=True)
    ends = ends.groupBy(*keys, "_chunk").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).where("_carry is not null").drop("_end")
    met = seen.join(carried, [*keys, "_chunk"], "left")
    found = F.coalesce("_hit", "_carry")
    return met.select(*[F.col(f"_left.{c}").alias(c) for c in own], *[found[c].alias(c) for c in rest], found["_t"].alias(f"matched_{time}"))


def _level(low: Column, high: Column) -> Column:
    """The least power of two that a range's length doesn't exceed."""
    return F.ceil(F.log2((high - low + 1).cast("double"))).cast("int")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], low: str = "min_offset", high: str = "max_offset") -> DataFrame:
    """All pairs of left and right rows of equal keys whose inclusive ranges [low, high] share a point: keys, then structs `left`
    and `right` of the rows.

    Ranges are put into bins. A range's level is its length as a power of two, and it lies in two bins of that width at most, or of
    any greater one; so it is sent to two bins for each level that either side has, its own and those above. Two ranges are a pair
    in the level of the longer one, in the first bin that both lie in: each pair comes out once. A very long range is as many rows
    as any other. Rows with nulls in keys or ends, and ranges that end before they begin, are in no pair.
    """
    sane = lambda df: df.where(F.col(low) <= F.col(high))
    levels = sorted({r[0] for df in (left, right) for r in sane(df).select(_level(F.col(low), F.col(high))).distinct().collect()})  # 64 at most
    if not levels:
        levels = [0]

    def binned(df: DataFrame, name: str) -> DataFrame:
        a, b = F.col(low), F.col(high)
        rows = sane(df).select(*keys, a.alias(f"{name}_low"), b.alias(f"{name}_high"), _level(a, b).alias(f"{name}_level"), F.struct(*df.columns).alias(name))
        sent = rows.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))).where(F.col("level") >= F.col(f"{name}_level"))
        width = F.pow(F.lit(2.0), F.col("level")).cast("long")
        bin_of = lambda c: F.floor(F.col(f"{name}_{c}") / width)
        return sent.withColumn(f"{name}_first", bin_of("low")).withColumn("bin", F.explode(F.sequence(bin_of("low"), bin_of("high"))))

    met = binned(left, "left").join(binned(right, "right"), [*keys, "level", "bin"])
    met = met.where(F.col("level") == F.greatest("left_level", "right_level")).where(F.col("bin") == F.greatest("left_first", "right_first"))
    return met.where((F.col("left_low") <= F.col("right_high")) & (F.col("right_low") <= F.col("left_high"))).select(*keys, "left", "right")
