"""Column expressions. All of them stay inside generated code; none calls Python per row."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgecast.schema import MISSING_TEXT, SEED


def text_or_missing(value: Column) -> Column:
    """Text of a value, with the word used for a missing one."""
    return F.coalesce(value.cast("string"), F.lit(MISSING_TEXT))


def joined_key(*values: Column) -> Column:
    """Interaction key: the values' texts joined by a double underscore."""
    return F.concat_ws("__", *[text_or_missing(v) for v in values])


def cut_label(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval holding the value; outside or NULL gives the missing word."""
    label = F.when(value.isNull() | (value <= F.lit(edges[0])), F.lit(MISSING_TEXT))
    for upper, text in zip(edges[1:], labels):
        label = label.when(value <= F.lit(upper), F.lit(text))
    return label.otherwise(F.lit(MISSING_TEXT))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def round_coordinate(value: Column) -> Column:
    """Two decimals, halves of the scaled binary value to even."""
    return F.rint(value * F.lit(100)) / F.lit(100)


def clip(value: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bound a value on either side; NULL stays NULL."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), bounded)


def parse_day(value: Column) -> Column:
    """Date of a text; NULL where it is no date."""
    return F.try_to_date(value.cast("string"))


def hash_text(key: Column, seed: int = SEED) -> Column:
    """Seeded hexadecimal digest of a row key: a row order no partitioning can change."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_number(key: Column, seed: int = SEED) -> Column:
    """First 32 bits of the seeded digest as a whole number."""
    return F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column, seed: int = SEED) -> Column:
    """Repeatable uniform number in [0, 1) for a row key."""
    return hash_number(key, seed) / F.lit(float(2**32))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def sorted_params_json(params: Column) -> Column:
    """JSON text of a string map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))
