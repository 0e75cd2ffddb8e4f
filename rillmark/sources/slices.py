"""Streams over files that arrive slice by slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a file of a slice, about.
FILE_ROWS = 1 << 18


def files_of(rows: int) -> int:
    """How many files a slice of so many rows should be."""
    return max(1, -(-rows // FILE_ROWS))


def stage(rows: DataFrame, slice_column: str, path: str, files: int = 1) -> int:
    """Writes rows as slices, one for each value of an integer column, and dates their files in that order: stream() reads them so.
    Returns how many there are. Works on any file system that has times of files; each file is dated a second after the one before.

    A slice is dealt over as many as `files` tasks and files by a hash of its rows. All slices have to be the same number of files, as
    a stream takes a number of files for a batch: where there are fewer, files without rows are put beside them."""
    placed = rows.withColumn("_slice", F.col(slice_column).cast("long"))
    dealt = placed.repartition("_slice") if files == 1 else placed.repartition("_slice", F.pmod(F.xxhash64(*rows.columns), F.lit(files)))
    dealt.write.partitionBy("_slice").parquet(path)
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list] = {}
    for d in fs.listStatus(folder):
        name = d.getPath().getName()
        if name.startswith("_slice="):
            found[int(name.removeprefix("_slice="))] = _parts(fs, d.getPath())
    most = max(map(len, found.values()), default=0)
    if any(len(parts) < most for parts in found.values()):
        rows.limit(0).coalesce(1).write.parquet(f"{path}-empty")
        [empty] = _parts(fs, jvm.org.apache.hadoop.fs.Path(f"{path}-empty"))
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for parts in found.values():
            for k in range(len(parts), most):
                beside = jvm.org.apache.hadoop.fs.Path(parts[0].getParent(), f"part-empty-{k}.parquet")
                jvm.org.apache.hadoop.fs.FileUtil.copy(fs, empty, fs, beside, False, conf)
                parts.append(beside)
    begin = 1_600_000_000_000
    for k, file in enumerate(file for _, parts in sorted(found.items()) for file in parts):
        fs.setTimes(file, begin + 1000 * k, -1)
    return len(found)


def _parts(fs, folder) -> list:
    return [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]


def _files(spark: SparkSession, path: str) -> int:
    """Files of each slice."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return next((len(_parts(fs, d.getPath())) for d in fs.listStatus(folder) if d.getPath().getName().startswith("_slice=")), 1)


def stream(spark: SparkSession, path: str, schema, slices: int = 1) -> DataFrame:
    """The staged rows as a stream; a batch reads so many slices."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", slices * _files(spark, path)).option("maxFileAge", "36500d")
    return reader.parquet(path).drop("_slice")
