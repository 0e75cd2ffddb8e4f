"""A table of rows by key that a stream writes to: each batch adds the keys that it changes, and the newest row of a key counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.workspace import Files

#: Runs of a level that are merged into one of the next.
FAN = 8
VERSION = "_version"


class KeyedTable:
    """Runs of rows in <root>/runs, and <root>/CURRENT, which names those that count, oldest first.

    put() writes the changed keys of a batch as a run of level 0 and makes it count by one rename; a batch that counts already
    is left as it is, so a replay changes nothing. FAN runs of a level are merged into one of the next level, newest row
    first: after n batches there are FAN * log(n) runs at most, and a row is rewritten once a level. Runs that a merge has
    replaced stay until the next one, for readers that have begun.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], fan: int = FAN) -> None:
        self.spark, self.root, self.key, self.fan = spark, root.rstrip("/"), list(key), fan
        self.files = Files(spark)

    def _current(self) -> dict:
        data = self.files.read(f"{self.root}/CURRENT")
        return json.loads(data) if data else {"last": -1, "runs": [], "old": [], "schema": None}

    def runs(self) -> list[tuple[int, int]]:
        """(level, last batch) of the runs that count, oldest first."""
        return [(r["level"], r["last"]) for r in self._current()["runs"]]

    def put(self, rows: DataFrame, batch: int) -> None:
        """Makes rows, one a key, the newest ones of their keys. Batches come in order. rows is run once in any case: a stream's
        state for a batch is made by running it."""
        now = self._current()
        if batch <= now["last"]:
            rows.write.format("noop").mode("overwrite").save()
            return
        made = rows.withColumn(VERSION, F.lit(batch).cast("long"))
        path = f"{self.root}/runs/{batch:020d}-0"
        made.write.mode("overwrite").parquet(path)
        now |= {"last": batch, "runs": [*now["runs"], {"path": path, "level": 0, "last": batch}], "schema": made.schema.json()}
        self._swap(now)
        self._merge(now)

    def _merge(self, now: dict) -> None:
        while True:
            level = next((v for v in sorted({r["level"] for r in now["runs"]}) if sum(r["level"] == v for r in now["runs"]) >= self.fan), None)
            if level is None:
                return
            full = [r for r in now["runs"] if r["level"] == level]
            path = f"{self.root}/runs/{full[-1]['last']:020d}-{level + 1}-{uuid.uuid4().hex[:8]}"
            self._newest(self._read(now, full)).write.parquet(path)
            # levels fall from the oldest run to the newest, so those of one level lie side by side
            at = now["runs"].index(full[0])
            rest = [r for r in now["runs"] if r not in full]
            rest.insert(at, {"path": path, "level": level + 1, "last": full[-1]["last"]})
            gone = now["old"]
            now |= {"runs": rest, "old": [r["path"] for r in full]}
            self._swap(now)
            for p in gone:
                self.files.delete(p)

    def _swap(self, now: dict) -> None:
        self.files.replace(f"{self.root}/CURRENT", json.dumps(now).encode())

    def _read(self, now: dict, runs: list[dict]) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*[r["path"] for r in runs])

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        # column by column, as a key is once in a version: numbers are then kept in hash maps, without a sort by key
        return rows.groupBy(*self.key).agg(*[F.max_by(c, VERSION).alias(c) for c in rest])

    def rows(self) -> DataFrame | None:
        """The newest row of each key; None before the first batch."""
        now = self._current()
        if not now["runs"]:
            return None
        found = self._read(now, now["runs"])
        return (found if len(now["runs"]) == 1 else self._newest(found)).drop(VERSION)
