"""Table profiles: counts, NULLs, summary statistics, correlations, group prices."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.functions.lookups import join_lookup, sized
from lodgecast.functions.quantiles import grouped_quantiles, value_counts


def top_counts(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """Rows per value, the most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    ordered = counts.orderBy(F.desc("rows"), column)
    return ordered.limit(rows) if rows else ordered


def counts_in_order(df: DataFrame, column: str) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(column)


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per value."""
    counts = sized(df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("percent", F.col("rows") / total * 100).orderBy(F.desc("rows"), column)


def price_by(df: DataFrame, column: str) -> DataFrame:
    """Rows, mean and median price per value, the highest median first; one pass over the listings."""
    counts = value_counts(df, [column], "price")
    n, price = F.col("n_value"), F.col("price")
    return (
        counts.groupBy(column)
        .agg(
            F.sum(n).alias("rows"),
            (F.sum(price * n) / F.sum(n)).alias("mean_price"),
            F.percentile(price, F.lit(0.5), n).alias("median_price"),
        )
        .orderBy(F.desc("median_price"), column)
    )


def two_way_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.groupBy(first, second).agg(F.count(F.lit(1)).alias("rows")).orderBy(first, second)


def two_way_share(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Percentage of each row's listings per column value; all values count for the total.

    Listings are counted once per pair and the pivot works on those counts.
    """
    pairs = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("rows"))
    shares = [
        (F.sum(F.when(F.col(column) == v, F.col("rows")).otherwise(0)) * 100.0 / F.sum("rows")).alias(v) for v in values
    ]
    return pairs.groupBy(row).agg(*shares).orderBy(row)


def top_neighbourhoods(df: DataFrame, min_rows: int = 30, rows: int = 15) -> DataFrame:
    """Neighbourhoods with the highest median price, with the borough of their first listing."""
    borough = df.groupBy("neighbourhood").agg(F.min_by("neighbourhood_group", "id").alias("neighbourhood_group"))
    priced = price_by(df, "neighbourhood").filter(F.col("rows") >= min_rows)
    top = priced.orderBy(F.desc("median_price"), "neighbourhood").limit(rows)
    return (
        join_lookup(top, borough, ["neighbourhood"])
        .select("neighbourhood", "neighbourhood_group", "rows", "median_price")
        .orderBy(F.desc("median_price"), "neighbourhood")
    )


def boroughs_of(df: DataFrame, neighbourhoods: DataFrame) -> DataFrame:
    """Boroughs seen among the listings of given neighbourhoods."""
    chosen = neighbourhoods.select("neighbourhood")
    pairs = df.groupBy("neighbourhood", "neighbourhood_group").agg(F.count(F.lit(1)))
    return pairs.join(chosen, "neighbourhood", "left_semi").select("neighbourhood_group").distinct()


def null_counts(df: DataFrame) -> DataFrame:
    """NULL values per column, in one pass."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "nulls")


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: position, type, and values present, with the table's row count."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f.name).alias("present"),
            F.col("__rows").alias("rows"),
        )
        for i, f in enumerate(df.schema)
    ]
    return wide.select(F.inline(F.array(*entries)))


def first_rows(df: DataFrame, rows: int = 5, key: str = "id") -> DataFrame:
    return df.orderBy(key).limit(rows)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per numeric column."""
    stats, wanted = [], {}
    for c in columns:
        v = F.col(c).cast("double")
        parts = [F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)]
        stats += [p.alias(f"{c}__{n}") for p, n in zip(parts, ("count", "mean", "std", "min", "max"))]
        wanted.update({f"{c}__q{q}": (c, q / 100) for q in (25, 50, 75)})
    wide = grouped_quantiles(df, [], wanted, stats)
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{c}__{n}").alias(n) for n in ("count", "mean", "std", "min")],
            *[F.col(f"{c}__q{q}").alias(f"q{q}") for q in (25, 50, 75)],
            F.col(f"{c}__max").alias("max"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*entries)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, over the rows where both values are present; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    entries = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            entries.append(F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"p{i}").alias("r")))
    return wide.select(F.inline(F.array(*entries)))
