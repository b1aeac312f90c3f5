"""Indicator columns per category value."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def categories(df: DataFrame, column: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct values of a column that is to become one output column per value."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values; use the target mean instead")
    return sorted(row[0] for row in found)


def indicators(df: DataFrame, column: str, prefix: str | None = None, drop_first: bool = False,
               values: Sequence[str] | None = None) -> DataFrame:
    """Replace a column by 0/1 columns ``prefix_value``; NULL gives zeros everywhere."""
    names = list(values) if values is not None else categories(df, column)
    kept = names[1:] if drop_first else names
    marks = {
        f"{prefix or column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in kept
    }
    return df.withColumns(marks).drop(column) if marks else df.drop(column)
