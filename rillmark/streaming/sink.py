"""Idempotent writes: raw rows and report partials, each kept under its range's token."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.state import insert_token
from rillmark.model import REPORTS, TRANSACTION_COLUMNS, TRANSACTIONS
from rillmark.operators import reports
from rillmark.streaming.ledger import each
from rillmark.workspace import Files

#: Offsets of a range that go to one file: a longer range is written by several tasks.
FILE_OFFSETS = 1 << 18

_ROWS = {"transactions": TRANSACTIONS, "reports": REPORTS}
_KEYS = "partition_id bigint, token string"


class Rejected(ValueError):
    """A write that would break exactly-once."""


def _columns(name: str) -> list[str]:
    return [c.split(" ")[0] for c in _ROWS[name].split(", ")]


class TokenSink:
    """Tables <root>/<stream>/transactions and reports, in folders by partition_id and token.

    Writing a range again overwrites the folder of its token, so it changes nothing. A range that overlaps a
    written one of another extent is refused: <root>/<stream>/extents/<partition> holds what has been written as a few
    merged intervals, and the range that is being written. compact() folds settled tokens into larger files; a token that is
    folded is left out when the rest is read, so that a late replay isn't counted twice.
    """

    def __init__(self, spark: SparkSession, root: str, stream: str = "main") -> None:
        self.spark = spark
        self.base = f"{root.rstrip('/')}/{stream}"
        self.files = Files(spark)

    # writing

    def push(self, transactions: DataFrame, ranges: DataFrame) -> None:
        """Writes the rows of ranges (partition_id, min_offset, max_offset). Each row has to be in its partition's range."""
        rows = ranges.select("partition_id", "min_offset", "max_offset").collect()  # a row for each topic partition
        if not rows:
            return
        for r in rows:
            if r.min_offset > r.max_offset:
                raise Rejected(f"partition {r.partition_id}: {r.min_offset} is greater than {r.max_offset}")
        each(self._begin, rows)
        bounds = self.spark.createDataFrame(rows, "partition_id bigint, min_offset bigint, max_offset bigint")
        placed = transactions.select(*TRANSACTION_COLUMNS).join(F.broadcast(bounds), "partition_id", "left")
        inside = F.col("offset").between(F.col("min_offset"), F.col("max_offset"))
        checked = F.when(F.coalesce(inside, F.lit(False)), insert_token(F.col("partition_id"), F.col("min_offset"), F.col("max_offset"))).otherwise(
            F.raise_error(F.concat_ws(" ", F.lit("row outside its range: partition"), F.col("partition_id").cast("string"), F.lit("offset"), F.col("offset").cast("string")))
        )
        chunk = F.floor((F.col("offset") - F.col("min_offset")) / FILE_OFFSETS)
        tagged = placed.select(*TRANSACTION_COLUMNS, F.current_timestamp().alias("write_time"), checked.alias("token"), chunk.alias("chunk"))
        # a file holds a chunk of a range, in the order that readers filter by
        dealt = tagged.repartition("token", "chunk").sortWithinPartitions("partition_id", "token", "chunk", "date", "user_id", "offset").drop("chunk")
        self._write(dealt, "transactions")
        # partials are made of what has been written: the input is read and decoded once
        new = self._of_tokens("transactions", [(r.partition_id, _token(r.partition_id, r.min_offset, r.max_offset)) for r in rows])
        partial = reports.partials(new, "token").select(*_columns("reports"), "token")
        self._write(partial.sortWithinPartitions("partition_id", "token", "date", "user_id", "product_id"), "reports")
        each(self._end, rows)

    def _begin(self, r) -> None:
        """Notes that a range is being written; refuses what overlaps another one. A replay is fine: its token is there, or
        it is folded."""
        now, said = [r.min_offset, r.max_offset], self._extents(r.partition_id)
        done, begun = said["extents"], said["begun"]
        if begun and begun != now and self._has(r.partition_id, *begun):
            done = _merged([*done, begun])  # a write that ended without a note of it
        clash = next(((a, b) for a, b in done if a <= now[1] and b >= now[0]), None)
        if clash and not self._has(r.partition_id, *now) and not self._is_folded(_token(r.partition_id, *now)):
            raise Rejected(f"partition {r.partition_id}: {now[0]}-{now[1]} overlaps a written range within {clash[0]}-{clash[1]}")
        self._note(r.partition_id, done, now)

    def _end(self, r) -> None:
        self._note(r.partition_id, _merged([*self._extents(r.partition_id)["extents"], [r.min_offset, r.max_offset]]), None)

    def _note(self, partition: int, extents: list[list[int]], begun: list[int] | None) -> None:
        self.files.replace(f"{self.base}/extents/{partition}", json.dumps({"extents": extents, "begun": begun}).encode())

    def _has(self, partition: int, low: int, high: int) -> bool:
        return self.files.exists(f"{self.base}/transactions/partition_id={partition}/token={_token(partition, low, high)}")

    def _extents(self, partition: int) -> dict:
        data = self.files.read(f"{self.base}/extents/{partition}")
        return json.loads(data) if data else {"extents": [], "begun": None}

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_id", "token").parquet(f"{self.base}/{name}")

    # reading

    def written(self) -> DataFrame:
        """What has been written, as merged intervals (partition_id, min_offset, max_offset): a few for each partition."""
        found = [int(n) for n in self.files.names(f"{self.base}/extents") if n.isdigit()]
        rows = [(p, a, b) for p, said in zip(found, each(self._extents, found), strict=True) for a, b in said["extents"]]
        return self.spark.createDataFrame(rows, "partition_id bigint, min_offset bigint, max_offset bigint")

    def _read(self, name: str) -> DataFrame:
        """All rows under tokens, with partition_id and token."""
        columns = [*_columns(name), "token"]
        path = f"{self.base}/{name}"
        if not any(n.startswith("partition_id=") for n in self.files.names(path)):
            return self.spark.createDataFrame([], f"{_ROWS[name]}, token string")
        return self.spark.read.schema(f"{_ROWS[name]}, token string").parquet(path).select(*columns)

    def _of_tokens(self, name: str, tokens: list[tuple[int, str]]) -> DataFrame:
        """The rows of some tokens: only their folders are listed. A range without rows has no folder."""
        path = f"{self.base}/{name}"
        folders = [f"{path}/partition_id={p}/token={t}" for p, t in tokens]
        there = [f for f, has in zip(folders, each(self.files.exists, folders), strict=True) if has]
        if not there:
            return self.spark.createDataFrame([], f"{_ROWS[name]}, token string")
        return self.spark.read.schema(f"{_ROWS[name]}, token string").option("basePath", path).parquet(*there)

    def tokens(self) -> DataFrame:
        """(partition_id, token) of the folders that hold raw rows, folded or not."""
        return self._read("transactions").select("partition_id", "token").distinct()

    def transactions(self) -> DataFrame:
        """All raw rows: the folded ones, and those of tokens that aren't folded."""
        said = self._current()
        fresh = self._read("transactions")
        if said is None:
            return fresh.drop("token")
        old = self.spark.read.schema(TRANSACTIONS).parquet(*[f"{self.base}/generations/{g}/transactions" for g in said["raw"]])
        return old.unionByName(fresh.join(self._folded(said), "token", "left_anti").drop("token"))

    def partials(self) -> DataFrame:
        """Report partials: the current generation's, and those of tokens that it doesn't hold."""
        said = self._current()
        fresh = self._read("reports")
        if said is None:
            return fresh.drop("token")
        old = self.spark.read.schema(REPORTS).parquet(f"{self.base}/generations/{said['reports']}/reports")
        return old.unionByName(fresh.join(self._folded(said), "token", "left_anti").drop("token"))

    def reports(self) -> DataFrame:
        return reports.merged(self.partials())

    # compaction

    def _current(self) -> dict | None:
        """raw: the generations that hold raw rows and tokens; reports: the one that holds the merged partials."""
        data = self.files.read(f"{self.base}/generations/CURRENT")
        return json.loads(data) if data else None

    def _folded(self, said: dict) -> DataFrame:
        return self.spark.read.schema(_KEYS).parquet(*[f"{self.base}/generations/{g}/tokens" for g in said["raw"]]).select("token")

    def _is_folded(self, token: str) -> bool:
        said = self._current()
        return said is not None and bool(self._folded(said).where(F.col("token") == token).head(1))

    def compact(self, ledger: DataFrame) -> int:
        """Folds the raw rows and partials of settled tokens into a new generation; returns how many tokens it folds.

        A token is settled unless its range is the one in progress. Raw rows are added to those of earlier generations,
        partials are merged with them. The generation takes effect by one rename. Folders of tokens that earlier
        generations hold are deleted first: no reader that began since needs them.
        """
        said = self._current()
        if said is not None:
            self._drop_folders(said)
        open_ = ledger.where("state <> 2").select(insert_token(F.col("partition_id"), F.col("min_offset"), F.col("max_offset")).alias("token"))
        names = self.tokens().join(open_, "token", "left_anti")
        if said is not None:
            names = names.join(self._folded(said), "token", "left_anti")
        new = uuid.uuid4().hex
        path = f"{self.base}/generations/{new}"
        names.select("partition_id", "token").write.parquet(f"{path}/tokens")
        names = self.spark.read.schema(_KEYS).parquet(f"{path}/tokens").select("token")
        count = names.count()
        if not count:
            self.files.delete(path)
            return 0
        raw = self._read("transactions").join(names, "token", "left_semi").drop("token")
        raw.repartitionByRange("partition_id", "offset").sortWithinPartitions("partition_id", "date", "user_id", "offset").write.parquet(f"{path}/transactions")
        rows = self._read("reports").join(names, "token", "left_semi").drop("token")
        if said is not None:
            rows = rows.unionByName(self.spark.read.schema(REPORTS).parquet(f"{self.base}/generations/{said['reports']}/reports"))
        # partition_id has no meaning in folded rows
        folded = reports.merged(rows).select("date", "user_id", "product_id", F.lit(None).cast("bigint").alias("partition_id"), "amount", "offset", "write_time")
        folded.write.parquet(f"{path}/reports")
        self.files.replace(f"{self.base}/generations/CURRENT", json.dumps({"raw": [*(said["raw"] if said else []), new], "reports": new}).encode())
        return count

    def _drop_folders(self, said: dict) -> None:
        """Deletes the folders of the tokens that the last generation has folded; one by one, never all names at once."""
        last = self.spark.read.schema(_KEYS).parquet(f"{self.base}/generations/{said['raw'][-1]}/tokens")
        for r in last.toLocalIterator():
            for name in _ROWS:
                self.files.delete(f"{self.base}/{name}/partition_id={r.partition_id}/token={r.token}")

    # parts of ranges in progress

    def pending(self, partitions: list[int]) -> DataFrame | None:
        """The parts that are kept aside for some partitions."""
        names = each(lambda p: self.files.read(f"{self.base}/pending/{p}/CURRENT"), partitions)
        paths = [f"{self.base}/pending/rows-{n.decode()}/partition_id={p}" for p, n in zip(partitions, names, strict=True) if n]
        if not paths:
            return None
        frames = [self.spark.read.schema(_pending()).parquet(path).withColumn("partition_id", F.lit(int(path.rsplit("=", 1)[1])).cast("bigint")) for path in paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.select(*TRANSACTION_COLUMNS)

    def keep_pending(self, rows: DataFrame, partitions: list[int]) -> None:
        """Keeps the rows of these partitions aside, by one job."""
        name = uuid.uuid4().hex
        rows.where(F.col("partition_id").isin(partitions)).write.partitionBy("partition_id").parquet(f"{self.base}/pending/rows-{name}")
        each(lambda p: self.files.replace(f"{self.base}/pending/{p}/CURRENT", name.encode()), partitions)

    def drop_pending(self, partitions: list[int]) -> None:
        each(lambda p: self.files.delete(f"{self.base}/pending/{p}"), partitions)


def _pending() -> str:
    return ", ".join(c for c in TRANSACTIONS.split(", ") if c.split(" ")[0] in TRANSACTION_COLUMNS and not c.startswith("partition_id"))


def _token(partition: int, low: int, high: int) -> str:
    return f"transactions-insert-{partition}-{low}-{high}"


def _merged(intervals: list[list[int]]) -> list[list[int]]:
    """Intervals in order, joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
