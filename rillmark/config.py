"""Settings of an ingestion job, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from rillmark.model import BATCH_SIZE

PREFIX = "RILLMARK_"


@dataclass(frozen=True)
class Settings:
    """Each field is read from RILLMARK_<FIELD>; empty variables count as unset."""

    topic: str = ""
    ledger: str = ""
    leases: str = ""
    tables: str = ""
    checkpoint: str = ""
    stream: str = "main"
    owner: str = ""
    batch_size: int = BATCH_SIZE
    batch_budget: float = 60.0
    lease_ttl: float = 120.0
    lease_wait: float = 20.0

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            text = env.get(PREFIX + f.name.upper(), "")
            if text:
                try:
                    found[f.name] = type(f.default)(text)
                except ValueError:
                    raise ValueError(f"{PREFIX}{f.name.upper()} is {text!r}, not a number") from None
        made = cls(**found)
        if min(made.batch_size, made.batch_budget, made.lease_ttl) <= 0 or made.lease_wait < 0:
            raise ValueError(f"sizes and times have to be positive: {made}")
        return made
