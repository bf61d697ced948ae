"""Filtering wide rows by a set of keys: broadcast behind a count of the keys, else a shuffle join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of some twenty bytes: at most about 20 MB are broadcast.
BROADCAST_KEYS = 500_000


def by_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", n_keys: int | None = None) -> DataFrame:
    """left_semi, left_anti or inner join with keys that have been counted."""
    n = keys.count() if n_keys is None else n_keys
    return rows.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, on, how)
