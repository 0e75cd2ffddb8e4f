"""A partitioned topic log in files, and its batch and streaming readers.

Layout: <root>/partition=<p>/<first offset, 20 digits>-<messages>.jsonl, a message a line. A segment is written
beside its place and renamed, so that readers see whole segments. Offsets count lines from 0 in each partition. A
segment holds SEGMENT messages at most, so that the names say where a partition ends, and a reader finds an offset by
skipping lines of one segment.

root is a path that the driver and all executors have mounted: readers run in Python, without Hadoop's file systems.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rillmark.model import BATCH_SIZE, TOPIC

#: Messages of a segment at most, and those of a batch that a task reads at most.
SEGMENT, READ = 1 << 14, 1 << 16


def local(path: str) -> str:
    """A file: url as a path; other file systems are refused."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if not plain.startswith("/"):
        raise ValueError(f"a topic log needs a mounted folder, not {path}")
    return plain


def _segments(root: str, partition: int) -> list[tuple[int, int, str]]:
    """(first offset, messages, path), in order."""
    folder = f"{root}/partition={partition}"
    if not os.path.isdir(folder):
        return []
    return sorted((*map(int, n[:-6].split("-")), f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".jsonl"))


def _write_segment(root: str, partition: int, first: int, messages: list[str]) -> None:
    folder = f"{root}/partition={partition}"
    os.makedirs(folder, exist_ok=True)
    beside = f"{folder}/.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        f.writelines(m.replace("\n", " ") + "\n" for m in messages)
        f.flush()
        os.fsync(f.fileno())
    os.rename(beside, f"{folder}/{first:020d}-{len(messages)}.jsonl")


def partitions(root: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in os.listdir(root) if n.startswith("partition=")) if os.path.isdir(root) else []


def end_offset(root: str, partition: int) -> int:
    """The offset that the next message will get."""
    found = _segments(root, partition)
    return found[-1][0] + found[-1][1] if found else 0


def batch_messages(root: str, batches: int, least: int, most: int) -> int:
    """How many messages of a partition a batch has to take for the log to be so many batches; least to most."""
    longest = max((end_offset(root, p) for p in partitions(root)), default=0)
    return max(least, min(most, -(-longest // batches)))


def append(root: str, partition: int, messages: list[str]) -> tuple[int, int]:
    """Appends messages as segments and returns their range. One producer a partition."""
    first = end_offset(root, partition)
    for a in range(0, len(messages), SEGMENT):
        _write_segment(root, partition, first + a, messages[a : a + SEGMENT])
    return first, first + len(messages) - 1


def recreate(root: str) -> None:
    """Drops the log with all its segments; the next message of each partition gets offset 0."""
    shutil.rmtree(root, ignore_errors=True)
    if os.path.exists(root):
        raise OSError(f"{root} is still there")
    os.makedirs(root)


def produce(topic: DataFrame, root: str) -> None:
    """Writes topic rows (partition_id, offset, value) as the log's first segments, on the executors.

    root is a folder that they share. Offsets have to be contiguous from 0 in each partition. A segment is written by
    one task, a partition by as many as it has segments. A task that runs again writes the same names.
    """

    def run(batches):
        import pyarrow as pa

        held: list[str] = []
        key = begin = None

        def out() -> None:
            if held:
                _write_segment(root, key[0], begin, held)

        for batch in batches:
            for p, o, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (p, o // SEGMENT) != key:
                    out()
                    held, key, begin = [], (p, o // SEGMENT), o
                    if o % SEGMENT:
                        raise ValueError(f"offset {o} of partition {p} where {o // SEGMENT * SEGMENT} was due")
                if o != begin + len(held):
                    raise ValueError(f"offset {o} of partition {p} where {begin + len(held)} was due")
                held.append(v)
        out()
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    rows = topic.select("partition_id", "offset", "value").withColumn("segment", F.floor(F.col("offset") / SEGMENT))
    rows.repartition("partition_id", "segment").sortWithinPartitions("partition_id", "offset").mapInArrow(run, "done int").count()


def _lines(root: str, partition: int, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    for first, count, path in _segments(root, partition):
        if first + count <= start:
            continue
        if first >= end:
            return
        with open(path, encoding="utf-8") as f:
            for offset, line in enumerate(f, first):
                if offset >= end:
                    return
                if offset >= start:
                    yield partition, offset, line[:-1]


class _Slice(InputPartition):
    def __init__(self, partition: int, start: int, end: int) -> None:
        self.partition, self.start, self.end = partition, start, end


class _Reader(DataSourceStreamReader):
    """Offsets are {partition: next offset}. A batch takes at most `most` messages of each partition.

    The cut of a batch is made here, in latestOffset, which Spark logs before it runs the batch: a replay
    reads exactly the same ranges.
    """

    def __init__(self, options: dict) -> None:
        self.root = local(options["path"])
        self.most = int(options.get("maxmessages", BATCH_SIZE))
        self.start = {int(k): int(v) for k, v in json.loads(options.get("startoffsets", "{}")).items()}
        self.at: dict[int, int] | None = None

    def initialOffset(self) -> dict:
        return {str(p): self.start.get(p, 0) for p in partitions(self.root)}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = {int(p): o for p, o in self.initialOffset().items()}
        out = {}
        for p in partitions(self.root):
            now = self.at.get(p, self.start.get(p, 0))
            out[p] = max(now, min(end_offset(self.root, p), now + self.most))
        return {str(p): o for p, o in out.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # what is read now is where the next cut begins, also after a restart
        self.at = {int(p): o for p, o in end.items()}
        found = []
        for p, o in end.items():
            first = start.get(p, self.start.get(int(p), 0))
            # a long range is read by several tasks, cut where segments begin
            cuts = [first, *range((first // READ + 1) * READ, o, READ), o]
            found += [_Slice(int(p), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return found

    def read(self, partition: _Slice):
        yield from _lines(self.root, partition.partition, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        """Spark's own commit log holds what is done."""


class TopicSource(DataSource):
    """spark.readStream.format("topiclog").load(root); options maxMessages, startOffsets (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "topiclog"

    def schema(self) -> str:
        return TOPIC

    def streamReader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicSource)


def stream(spark: SparkSession, root: str, start: dict[int, int] | None = None, most: int = BATCH_SIZE) -> DataFrame:
    register(spark)
    reader = spark.readStream.format("topiclog").option("maxMessages", most)
    if start:
        reader = reader.option("startOffsets", json.dumps({str(k): v for k, v in start.items()}))
    return reader.load(root)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All messages of the log as a batch: the segment's first offset plus the line's place. A segment is a row meanwhile."""
    lines = spark.read.text(f"{root}/partition=*/*.jsonl", wholetext=True).select(F.input_file_name().alias("f"), "value")
    parts = lines.select(
        F.regexp_extract("f", r"partition=(\d+)", 1).cast("bigint").alias("partition_id"),
        F.regexp_extract("f", r"(\d{20})-\d+\.jsonl", 1).cast("bigint").alias("first"),
        F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")),
    )
    return parts.select("partition_id", (F.col("first") + F.col("pos")).alias("offset"), F.col("col").alias("value"))
