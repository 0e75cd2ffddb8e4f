"""Shared pieces of the training-data operators: work folders, Arrow views, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.workspace import new_path

#: Texts that go to a Python worker at once. A single longer text makes a batch of its own.
ARROW_BATCH_BYTES = 4 << 20
ARROW_BATCH_ROWS = 4096

#: Bits of a filter for each id, and at most: 8 MB, which are broadcast. Beyond that filters let more through.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 26
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps

#: ASCII white space that separates words, as bytes.
WORD_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes, so that long texts don't pile up in a worker. Plans read these
    settings when they run, so they stay; smaller ones that the caller has made are kept."""
    for name, most in (("maxBytesPerBatch", ARROW_BATCH_BYTES), ("maxRecordsPerBatch", ARROW_BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        have = str(spark.conf.get(key)).lower().removesuffix("b")
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def work_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = new_path(spark, what)
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: its owner clears the shared folder
        return


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, what: str, column: str) -> DataFrame:
    """As stored(), bucketed by a column into as many buckets as a shuffle has partitions: joins on that column
    take these rows from where they are, and only the other side is moved. The table goes when the driver ends."""
    spark = df.sparkSession
    name = f"rillmark_{what}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", work_path(spark, what)).option("compression", "uncompressed").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended, and its catalogue with it
        return


def marked(rows: DataFrame, ids: DataFrame, column: str = "doc_id", name: str = "_may") -> DataFrame:
    """rows with a flag that is true where their id may be among ids: always if it is, else seldom. Rows stay where they are, as
    only bitmaps of the ids' hashes are broadcast. ids is read twice: it should be stored."""
    bits = min(MOST_FILTER_BITS, -(-max(1, FILTER_BITS * ids.count()) // _BITMAP) * _BITMAP)

    def slot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(bits)) + 1

    of_ids, own = slot(F.col(column)), slot(F.col(column))
    at = ids.select(F.bitmap_bucket_number(of_ids).alias("_bucket"), F.bitmap_bit_position(of_ids).alias("_at")).repartition("_bucket")
    maps = at.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    place = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(own)).join(F.broadcast(maps), "_bucket", "left")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)).alias(name))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are done with: it does when the driver's collector finds nothing that
    refers to them, and the last plan that was run is still referred to until another has been."""
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers live on, and blocks of several MB would
    otherwise leave their size behind in each allocator."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        return


def pieces(batch: pa.RecordBatch, column: str, limit: int = ARROW_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about limit bytes of a text column, one row at least."""
    n = batch.num_rows
    if not n:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(length) // max(limit, 1)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [n]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then those of begin[1], ..."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def ordered(values: np.ndarray) -> np.ndarray:
    """As np.argsort(kind="stable") of whole numbers of 0 or more: they are sorted with their places in their lowest bits, as that is
    several times as fast as sorting places. Should numbers differ in these bits alone, places are sorted."""
    bits = np.uint64(max(len(values), 1).bit_length())
    value, places = values.astype(np.uint64, copy=False), np.arange(len(values), dtype=np.uint64)
    fits = value.max(initial=0) < np.uint64(1) << (np.uint64(64) - bits)
    order = (np.sort((value << bits if fits else value >> bits << bits) | places) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not fits and ((found := value[order])[1:] < found[:-1]).any():
        return np.argsort(values, kind="stable")
    return order


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct whole numbers in order, where each is first, and each one's place among them, as np.unique() gives them."""
    order = ordered(values)
    found = values[order]
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    at = np.empty(len(found), np.int64)
    at[order] = np.cumsum(new) - 1
    return found[new], order[new], at


class Pool:
    """Numbers that are appended to, in an array that doubles."""

    def __init__(self, kind: type) -> None:
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.zeros(max(len(self.held), len(values)), self.held.dtype)))
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts as one array, and the n + 1 offsets of the texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SPACE)] = True
_HASH_OF_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH_OF_BYTE[list(WORD_SPACE)] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit of 64-bit values over all output bits; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, A-Z lower-cased, and the n + 1 offsets of each text's words.

    A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage
    return; no word goes over the end of a text. The hash is a polynomial over random odd values of
    the bytes, mixed: equal words have equal hashes, and different ones differ but for chance (2**-60).
    """
    hashes, starts, _, _ = word_spans(data, offsets)
    return hashes, starts


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), with each word's first byte and the byte after its last."""
    n = len(offsets) - 1
    none = np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(data):
        return none
    low = _LOWER[data]
    space = _SPACE[low]
    edge = offsets[:-1][np.diff(offsets) > 0]
    start = ~space
    start[1:] &= space[:-1]
    start[edge] = ~space[edge]
    at = np.flatnonzero(start)
    if not len(at):
        return none
    last = ~space
    last[:-1] &= space[1:]
    final = np.append(edge[1:], len(data)) - 1
    last[final] = ~space[final]
    end = np.flatnonzero(last) + 1
    span = np.diff(np.append(at, len(data)))
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(span.max()), _BASE))))
    inside = np.arange(at[0], len(data)) - np.repeat(at, span)
    value = _HASH_OF_BYTE[low[at[0] :]]
    value *= power[inside]
    return mixed(np.add.reduceat(value, at - at[0])), np.searchsorted(at, offsets), at, end


def shingles(hashes: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of size words of each text, and their n + 1 offsets.

    A text of fewer words gives the whole sequence as one; a text without words gives none.
    """
    count = np.diff(starts)
    odd = mixed(np.arange(1, size + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    total = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        total += padded[k : k + len(hashes)] * odd[k]
    keep = np.ones(len(hashes) + 1, bool)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    # positions that begin no whole run of a text
    ends = np.repeat(starts[:-1] + made, count)
    keep[:-1] = np.arange(len(hashes)) < ends
    short = np.flatnonzero((count > 0) & (count < size))
    for k in range(size - 1):
        has = short[count[short] > k]
        if k == 0:
            total[starts[has]] = count[has].astype(np.uint64) * odd[size - 1]
        total[starts[has]] += mixed(hashes[starts[has] + k] + odd[k])
    return mixed(total[keep[:-1]]), np.concatenate(([0], np.cumsum(made)))
