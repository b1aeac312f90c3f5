"""Exact quantiles (linear interpolation) and quantile bands by radix selection.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here every value has an order-keeping 64-bit
integer. A first round counts the rows of each group by the leading 16 bits, combined before rows move; the counts say
which bucket holds each wanted rank. A bucket with few rows, or few values between its smallest and largest, is ranked value
by value; any other is cut again by the next 16 bits that differ inside it. So there are at most four rounds, for groups of
all sizes and columns of all types, and no task ever orders more than ``FEW`` entries of a group.

All rounds read one narrow table, the keys and the columns asked for, written once.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodgecast.functions.lookups import join_lookup
from lodgecast.functions.stored import stored

#: Bits that a round resolves.
BITS = 16
#: Buckets of so many rows, or of so many possible values, are ranked value by value.
FEW = 1 << 16

Wanted = Mapping[str, tuple[str, float]]


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows per distinct value; NULL values do not count."""
    return df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n_value"))


def ordered_bits(value: Column) -> Column:
    """A 64-bit integer for each double, in the order of the doubles: the exponent's 11 bits, then the fraction's 52.

    The rounded logarithm is off by one next to powers of two at most, which the two comparisons put right; powers of two
    and divisions by them are exact. Negative numbers are mirrored, not-a-number comes last.
    """
    size, infinity = F.abs(value), F.lit(float("inf"))
    plain = F.when((size > 0) & (size < infinity), size).otherwise(F.lit(1.0))
    guess = F.floor(F.log2(plain)).cast("int")
    above, below = F.pow(F.lit(2.0), guess + 1) <= plain, F.pow(F.lit(2.0), guess) > plain
    exponent = F.greatest(guess + above.cast("int") - below.cast("int"), F.lit(-1022))
    fraction = (plain / F.pow(F.lit(2.0), exponent) * F.lit(2.0**52)).cast("long")
    bits = F.shiftleft((exponent + 1022).cast("long"), 52) + fraction
    bits = F.when(size == 0, F.lit(0)).when(size == infinity, F.lit(2047 << 52)).otherwise(bits)
    # Without an otherwise, a null stays null.
    signed = F.when(value < 0, F.lit(-1)).otherwise(F.lit(1)) * bits
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value.isNotNull(), signed)


def from_bits(bits: Column) -> Column:
    """The double that ``ordered_bits`` maps to these bits."""
    size = F.abs(bits)
    exponent, fraction = F.shiftright(size, 52), size.bitwiseAND(F.lit((1 << 52) - 1)) * F.pow(F.lit(2.0), F.lit(-52))
    value = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-1022))).otherwise(
        (fraction + 1) * F.pow(F.lit(2.0), exponent - 1023)
    )
    value = F.when(bits == F.lit((1 << 63) - 1), F.lit(float("nan"))).otherwise(value)
    return F.when(bits < 0, -value).otherwise(value)


def quantile_array(df: DataFrame, column: str, probs: Sequence[float], **settings) -> DataFrame:
    """One row with ``q``, the exact quantiles of a column in the order asked for."""
    wanted = {f"q{i}": (column, p) for i, p in enumerate(probs)}
    return grouped_quantiles(df, [], wanted, **settings).select(F.array(*wanted).alias("q"))


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Wanted,
    aggregates: Sequence[Column] = (),
    bits: int = BITS,
    few: int = FEW,
) -> DataFrame:
    """Exact quantiles per group: ``keys`` plus one double column per wanted name.

    ``wanted`` maps an output name to (input column, probability). Further ``aggregates`` of ``df`` ride along. Without
    keys the result is one row. A group without values has null quantiles.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    numbers = [ordered_bits(F.col(c).cast("double")).alias(f"__b_{i}") for i, c in enumerate(columns)]
    narrow = stored(df.select(*keys, *numbers), "quantiles")
    entries = [
        F.when(F.col(f"__b_{i}").isNotNull(), F.struct(F.lit(i).alias("__i"), F.col(f"__b_{i}").alias("__b")))
        for i in range(len(columns))
    ]
    values = narrow.select(*keys, F.inline(F.array_compact(F.array(*entries))))
    ranked = _values_at(values, [*keys, "__i"], _asked(columns, wanted), bits, few)
    found = _interpolated(ranked, keys, columns, wanted)
    if keys:
        groups = df.groupBy(*keys).agg(*aggregates) if aggregates else narrow.select(*keys).distinct()
        return join_lookup(groups, found, keys).select(*groups.columns, *wanted)
    if not aggregates:
        return found
    groups = df.agg(*aggregates)
    row = found.select(F.struct("*")).scalar()
    return groups.withColumn("__q", row).select(*groups.columns, *[F.col("__q")[n].alias(n) for n in wanted])


def _asked(columns: list[str], wanted: Wanted) -> Column:
    """Probabilities asked of the column with number ``__i``."""
    probs = [sorted({float(p) for c, p in wanted.values() if c == column}) for column in columns]
    return F.array(*[F.array(*[F.lit(p) for p in own]) for own in probs])[F.col("__i")]


def _position(prob: Column, total: Column) -> Column:
    return prob * (total - 1)


def _counted() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("__b").alias("lo"), F.max("__b").alias("hi")]


def _values_at(values: DataFrame, group: list[str], asked: Column, bits: int, few: int) -> DataFrame:
    """``group, total, rank, bits``: the value at every rank that a probability of its column needs."""
    counted = values.groupBy(*group, F.shiftright("__b", 64 - bits).alias("__bucket")).agg(*_counted())
    whole = Window.partitionBy(*group)
    ahead = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(whole)
    spots = counted.withColumns({"total": total, "before": F.coalesce(F.sum("n").over(ahead), F.lit(0))})
    position = F.transform(asked, lambda p: _position(p, F.col("total")))
    ranks = F.array_distinct(F.flatten(F.transform(position, lambda x: F.array(F.floor(x), F.ceil(x)))))
    here = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    spots = spots.select(*group, "total", "before", "n", "lo", "hi", F.explode(here).alias("rank"))
    narrow_enough = []
    while True:
        cut = (F.col("n") > few) & (F.col("hi") - F.col("lo") >= few)
        noticed = Observation()
        spots = stored(spots.withColumn("cut", cut).observe(noticed, F.count_if("cut").alias("cut")), "ranks")
        narrow_enough.append(spots.filter("not cut").drop("cut"))
        if not noticed.get["cut"]:
            break
        spots = _cut_again(values, spots.filter("cut").drop("cut"), group, bits)
    last = narrow_enough[0]
    for part in narrow_enough[1:]:
        last = last.unionByName(part)
    ties = _inside(values, last, group).groupBy(*group, "before", "__b").agg(F.count(F.lit(1)).alias("n"))
    return _running(last, ties, group, "__b").select(*group, "total", "rank", F.col("__b").alias("bits"))


def _inside(values: DataFrame, spots: DataFrame, group: list[str]) -> DataFrame:
    """Values of the buckets that hold wanted ranks; a group has one bucket for each rank at most."""
    buckets = spots.select(*group, "before", "lo", "hi").distinct()
    return join_lookup(values, buckets, group, "inner").filter("__b between lo and hi")


def _running(spots: DataFrame, counted: DataFrame, group: list[str], order: str) -> DataFrame:
    """Entries of ``counted`` (``group, before, n``) that hold the wanted ranks of their bucket, with ``through``."""
    rows = Window.partitionBy(*group, "before").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counted.withColumn("through", F.col("before") + F.sum("n").over(rows))
    asked = spots.groupBy(*group, "before").agg(F.collect_set("rank").alias("ranks"), F.first("total").alias("total"))
    held = join_lookup(run, asked, [*group, "before"], "inner")
    here = F.filter("ranks", lambda r: (r < F.col("through")) & (r >= F.col("through") - F.col("n")))
    return held.withColumn("rank", F.explode(here))


def _cut_again(values: DataFrame, spots: DataFrame, group: list[str], bits: int) -> DataFrame:
    """The buckets in which the wanted ranks lie after the next bits below those that a whole bucket shares."""
    spread = F.length(F.bin(F.col("hi") - F.col("lo")))
    shifted = _inside(values, spots, group).withColumn("__shift", F.greatest(spread - bits, F.lit(0)).cast("int"))
    bucket = F.expr("shiftright(__b - lo, __shift)").alias("__bucket")
    counted = shifted.groupBy(*group, "before", bucket).agg(*_counted())
    found = _running(spots, counted, group, "__bucket")
    return found.select(*group, "total", (F.col("through") - F.col("n")).alias("before"), "n", "lo", "hi", "rank")


def _interpolated(ranked: DataFrame, keys: list[str], columns: list[str], wanted: Wanted) -> DataFrame:
    exact = []
    for name, (column, prob) in wanted.items():
        position = _position(F.lit(float(prob)), F.col("total"))
        own = F.col("__i") == columns.index(column)
        low = F.max(F.when(own & (F.col("rank") == F.floor(position)), F.col("v")))
        high = F.max(F.when(own & (F.col("rank") == F.ceil(position)), F.col("v")))
        share = F.max(F.when(own, position - F.floor(position)))
        exact.append(F.when(share == 0, low).otherwise(low + (high - low) * share).alias(name))
    return ranked.withColumn("v", from_bits(F.col("bits"))).groupBy(*keys).agg(*exact)


def quantile_edges(df: DataFrame, column: str, bands: int, drop_equal: bool = True, **settings) -> list[float]:
    """Edges of an equal-count cut, ``bands + 1`` numbers at most; equal edges merge or raise.

    The edges go into the plan as literals, so that whatever uses the bands is planned once.
    """
    found = quantile_array(df, column, [i / bands for i in range(bands + 1)], **settings).first()["q"]
    edges = [e for e in found or [] if e is not None]
    distinct = sorted(set(edges))
    if not drop_equal and 0 < len(distinct) < len(edges):
        raise ValueError(f"band edges of {column} must be unique: {edges}")
    return distinct


def band_of(value: Column, edges: Sequence[float]) -> Column:
    """Zero-based band of a value: right-closed, the first band closed on both sides."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    band = F.when(value <= F.lit(edges[1]), 0)
    for i, upper in enumerate(edges[2:-1], start=1):
        band = band.when(value <= F.lit(upper), i)
    return F.when(value.isNotNull(), band.otherwise(len(edges) - 2))


def with_bands(df: DataFrame, column: str, bands: int, prefix: str = "band", drop_equal: bool = True) -> DataFrame:
    """Add ``prefix``, ``prefix_lo`` and ``prefix_hi``: the row's band and its edges."""
    edges = quantile_edges(df, column, bands, drop_equal)
    ends = F.array(*[F.lit(e) for e in edges]) if edges else F.lit(None).cast("array<double>")
    return (
        df.withColumn(prefix, band_of(F.col(column).cast("double"), edges))
        .withColumn(f"{prefix}_lo", F.get(ends, F.col(prefix)))
        .withColumn(f"{prefix}_hi", F.get(ends, F.col(prefix) + 1))
    )
