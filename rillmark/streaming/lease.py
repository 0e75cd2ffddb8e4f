"""Partition leases that end by themselves."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from rillmark.workspace import Files


class FileLease:
    """A lease is an exclusive file <root>/<partition>/<number> with owner and end; the greatest number counts.

    acquire() refreshes the owner's own lease, and takes one that has ended or been released. Of two owners that
    try at once, one creates the next number and the other fails.
    """

    def __init__(self, spark: SparkSession, root: str, owner: str, ttl: float = 120.0, clock: Callable[[], float] = time.time) -> None:
        self.files, self.root, self.owner, self.ttl, self.clock = Files(spark), root.rstrip("/"), owner, ttl, clock

    def _last(self, partition: int) -> tuple[int, dict]:
        numbers = [int(n) for n in self.files.names(f"{self.root}/{partition}") if n.isdigit()]
        if not numbers:
            return 0, {"owner": "", "until": 0.0}
        data = self.files.read(f"{self.root}/{partition}/{max(numbers)}")
        # a file that is being written holds nothing yet: its owner has the lease from now
        return max(numbers), json.loads(data) if data else {"owner": "?", "until": self.clock() + self.ttl}

    def acquire(self, partition: int) -> bool:
        number, last = self._last(partition)
        if last["owner"] != self.owner and last["until"] > self.clock():
            return False
        return self._next(partition, number, self.clock() + self.ttl)

    def _next(self, partition: int, number: int, until: float) -> bool:
        made = self.files.create(f"{self.root}/{partition}/{number + 1}", json.dumps({"owner": self.owner, "until": until}).encode())
        if made and number:
            self.files.delete(f"{self.root}/{partition}/{number}")
        return made

    def release(self, partition: int) -> None:
        number, last = self._last(partition)
        if last["owner"] == self.owner:
            self._next(partition, number, 0.0)

    def clear(self) -> None:
        """Drops the leases of all partitions."""
        self.files.delete(self.root)

    def holder(self, partition: int) -> str | None:
        _, last = self._last(partition)
        return last["owner"] if last["until"] > self.clock() else None

    def wait(self, partition: int, budget: float = 60.0, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> bool:
        """Tries until the budget is used up."""
        end = self.clock() + budget
        while not self.acquire(partition):
            if self.clock() + pause > end:
                return False
            sleep(pause)
        return True
