"""Runs of consecutive offsets and what is missing between them, by chunks whose seams are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Offsets that a task sorts at once.
CHUNK = 1 << 16


def _chunked(rows: DataFrame, keys: list[str], offset: str, chunk: int) -> DataFrame:
    """Each offset of a key once, with its chunk; rows without one are left out."""
    once = rows.where(F.col(offset).isNotNull()).select(*keys, F.col(offset).cast("long").alias("_o")).distinct()
    return once.withColumn("_chunk", F.floor(F.col("_o") / chunk))


def islands(rows: DataFrame, keys: list[str], offset: str = "offset", chunk: int = CHUNK) -> DataFrame:
    """The longest runs of consecutive offsets of each key: keys, min_offset, max_offset, n. Repeats count once; null keys are a
    key like others.

    Offsets are ordered within chunks. A run inside a chunk is final; only runs that touch a chunk's first or last offset can go
    on in the next one, two a chunk at most, and these are put together by a window over them.
    """
    cut = _chunked(rows, keys, offset, chunk)
    place = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("_o"))
    runs = cut.withColumn("_run", F.col("_o") - place).groupBy(*keys, "_chunk", "_run").agg(F.min("_o").alias("min_offset"), F.max("_o").alias("max_offset"))
    runs = runs.select(*keys, "min_offset", "max_offset", ((F.pmod("min_offset", F.lit(chunk)) == 0) | (F.pmod("max_offset", F.lit(chunk)) == chunk - 1)).alias("_open"))
    by = Window.partitionBy(*keys).orderBy("min_offset")
    begins = F.coalesce(F.lag("max_offset").over(by) + 1 != F.col("min_offset"), F.lit(True))
    seams = runs.where("_open").withColumn("_begins", begins.cast("int")).withColumn("_island", F.sum("_begins").over(by))
    joined = seams.groupBy(*keys, "_island").agg(F.min("min_offset").alias("min_offset"), F.max("max_offset").alias("max_offset")).drop("_island")
    both = runs.where("not _open").drop("_open").unionByName(joined)
    return both.withColumn("n", F.col("max_offset") - F.col("min_offset") + 1)


def gaps(rows: DataFrame, keys: list[str], offset: str = "offset", chunk: int = CHUNK) -> DataFrame:
    """What is missing between a key's first and last offset: keys, min_offset, max_offset, n, a row for each run of missing ones.

    Gaps within a chunk lie between neighbours there; those over chunks between the last and first offsets of chunks that follow
    each other, of which there is one row a chunk.
    """
    cut = _chunked(rows, keys, offset, chunk)
    ahead = F.lead("_o").over(Window.partitionBy(*keys, "_chunk").orderBy("_o"))
    inside = cut.select(*keys, F.col("_o").alias("_a"), ahead.alias("_b"))
    ends = cut.groupBy(*keys, "_chunk").agg(F.min("_o").alias("_first"), F.max("_o").alias("_last"))
    over = ends.select(*keys, F.col("_last").alias("_a"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_b"))
    found = inside.unionByName(over).where(F.col("_b") > F.col("_a") + 1)
    return found.select(*keys, (F.col("_a") + 1).alias("min_offset"), (F.col("_b") - 1).alias("max_offset"), (F.col("_b") - F.col("_a") - 1).alias("n"))
