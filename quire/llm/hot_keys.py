"""Joins whose keys may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key up to which one task may hold them, and keys that may be broadcast at most.
FEW_ROWS, MOST_HOT = 1000, 1 << 20


def join_hot(rows: DataFrame, facts: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """rows joined with facts (one row per key; ``count``: how many of the rows have it). ``total``: the rows there are.

    Keys with many rows are looked up by broadcast, so their rows stay where they are; of these there are never more than
    MOST_HOT, as the least count rises with the total. The others meet by a shuffle in which no key is frequent."""
    many = max(FEW_ROWS, total // MOST_HOT + 1)
    hot = facts.where(F.col(count) > many)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(count) <= many), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
