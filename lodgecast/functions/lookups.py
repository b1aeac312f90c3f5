"""Joins to small derived tables whose size is known before the join is planned."""

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sized(lookup: DataFrame) -> DataFrame:
    """Compute a derived lookup once, so that the planner knows its real size.

    The join strategy then follows ``spark.sql.autoBroadcastJoinThreshold``: below it the lookup is
    broadcast and the big side stays where it is, above it both sides are shuffled and adaptive
    execution splits hot keys. Lost blocks are recomputed from lineage.
    """
    lookup = lookup.persist(StorageLevel.MEMORY_AND_DISK)
    lookup.count()
    return lookup


def join_lookup(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equality join of facts with a lookup; the key columns are kept once."""
    renamed = lookup.select(
        *[F.col(c).alias(f"__key_{c}") if c in on else F.col(c) for c in lookup.columns]
    )
    condition = None
    for c in on:
        part = facts[c].eqNullSafe(renamed[f"__key_{c}"])
        condition = part if condition is None else condition & part
    return facts.join(renamed, condition, how).drop(*[f"__key_{c}" for c in on])
