"""Chart-ready data: densities, histograms, box statistics, cumulative curves, review activity."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodgecast.functions.lookups import join_lookup, sized
from lodgecast.functions.quantiles import grouped_quantiles, quantile_array, value_counts
from lodgecast.functions.running import running_total
from lodgecast.functions.scalars import hash_uniform, parse_day
from lodgecast.operators.features import geo_cell
from lodgecast.operators.splits import capped_sample

# Rows a single task writes when counts are turned back into points.
POINTS_PER_CHUNK = 100_000


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram with every bin present; the last bin includes the maximum."""
    return _histogram(df, F.col(column).cast("double"), bins)


def _histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    values = df.select(value.alias("x")).filter(F.col("x").isNotNull())
    ends = values.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    flat = F.when(F.col("a") == F.col("b"), F.lit(0.5)).otherwise(F.lit(0.0))
    ends = ends.select(F.struct((F.col("a") - flat).alias("lo"), (F.col("b") + flat).alias("hi")).alias("e"))
    e = F.col("e")
    place = F.floor((F.col("x") - e["lo"]) * bins / (e["hi"] - e["lo"]))
    counts = (
        values.withColumn("e", ends.scalar())
        .select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("e", ends.scalar())
    width = (e["hi"] - e["lo"]) / bins
    return (
        every.join(counts, "bin", "left")
        .select(
            "bin",
            (e["lo"] + F.col("bin") * width).alias("bin_lo"),
            (e["lo"] + (F.col("bin") + 1) * width).alias("bin_hi"),
            F.coalesce("n", F.lit(0)).alias("rows"),
        )
        .orderBy("bin")
    )


def log_histogram(df: DataFrame, column: str, edges: int = 45) -> DataFrame:
    """Histogram of positive values over logarithmic bins, with the median to mark."""
    positive = df.filter(F.col(column) > 0)
    bins = _histogram(positive, F.log10(F.col(column).cast("double")), edges - 1)
    median = quantile_array(positive, column, [0.5]).select(F.col("q")[0]).scalar()
    return bins.select(
        "bin",
        F.pow(F.lit(10.0), "bin_lo").alias("bin_lo"),
        F.pow(F.lit(10.0), "bin_hi").alias("bin_hi"),
        "rows",
        median.alias("median"),
    )


def density(df: DataFrame, group: str, column: str, points: int = 200, cut: float = 3.0, min_rows: int = 10) -> DataFrame:
    """Gaussian density per group on an even grid; groups of ``min_rows`` rows or fewer are left out.

    Listings are first reduced to counts per whole-number value, so the curve is exact and its cost
    follows the number of distinct values, not the number of listings.
    """
    counts = sized(value_counts(df, [group], column))
    n, v = F.col("n_value"), F.col(column)
    total = F.sum(n)
    mean = F.sum(v * n) / total
    stats = counts.groupBy(group).agg(
        total.alias("n"), mean.alias("m"), F.min(v).alias("a"), F.max(v).alias("b")
    )
    centred = join_lookup(counts, sized(stats.filter(F.col("n") > min_rows)), [group], "inner")
    squares = centred.groupBy(group, "n", "a", "b").agg(F.sum(n * (v - F.col("m")) * (v - F.col("m"))).alias("ss"))
    h = F.sqrt(F.col("ss") / (F.col("n") - 1)) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grids = sized(
        squares.withColumn("h", h).filter(F.col("h") > 0).select(
            group,
            F.col("n").alias("__n"),
            F.col("h").alias("__h"),
            (F.col("a") - cut * F.col("h")).alias("__from"),
            ((F.col("b") - F.col("a") + 2 * cut * F.col("h")) / (points - 1)).alias("__step"),
        )
    )
    grid = join_lookup(counts, grids, [group], "inner").withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    x = F.col("__from") + F.col("point") * F.col("__step")
    z = (x - v) / F.col("__h")
    height = F.sum(n * F.exp(-z * z / 2)) / (F.first("__n") * F.first("__h") * F.sqrt(2 * F.pi()))
    return grid.groupBy(group, "point").agg(F.first(x).alias("x"), height.alias("density")).orderBy(group, "point")


def _quartiles(df: DataFrame, group: str, column: str) -> DataFrame:
    wanted = {"q1": (column, 0.25), "median": (column, 0.5), "q3": (column, 0.75)}
    return grouped_quantiles(df.filter(F.col(column).isNotNull()), [group], wanted, [F.count(F.lit(1)).alias("rows")])


def quartiles_by(df: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles per group, the highest median first."""
    return _quartiles(df, group, column).select(group, "rows", "q1", "median", "q3").orderBy(F.desc("median"), group)


def box_stats(df: DataFrame, group: str, column: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value within reach, and the number of values beyond them."""
    counts = sized(value_counts(df, [group], column))
    boxes = _quartiles(df, group, column)
    v, q1, q3 = F.col(column).cast("double"), F.col("q1"), F.col("q3")
    span = reach * (q3 - q1)
    inside = (v >= q1 - span) & (v <= q3 + span)
    return (
        join_lookup(counts, boxes, [group], "inner")
        .groupBy(group, "rows", "q1", "median", "q3")
        .agg(
            F.least(F.coalesce(F.min(F.when(inside, v)), q1), q1).alias("whisker_lo"),
            F.greatest(F.coalesce(F.max(F.when(inside, v)), q3), q3).alias("whisker_hi"),
            F.sum(F.when(inside, 0).otherwise(F.col("n_value"))).alias("outliers"),
        )
        .orderBy(group)
    )


def cumulative_steps(df: DataFrame, group: str, column: str) -> DataFrame:
    """Per group and value: listings with the value, listings below it, listings in the group."""
    counts = value_counts(df, [group], column).withColumnRenamed("n_value", "rows")
    return running_total(counts, group, column, "rows").select(group, column, "rows", "below", "total")


def cumulative_points(df: DataFrame, group: str, column: str, chunk: int = POINTS_PER_CHUNK) -> DataFrame:
    """One point per listing: value and its place 1/n, 2/n, ... among the group's sorted values.

    The points follow from the value counts alone, so the listings are never sorted: a value shared by
    very many listings is cut into chunks that are spread over tasks before they are written out.
    """
    steps = cumulative_steps(df, group, column)
    last = F.floor((F.col("rows") - 1) / chunk)
    chunks = steps.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    spread = chunks.repartition(group, column, "chunk")
    start = F.col("chunk") * chunk + 1
    stop = F.least(start + chunk - 1, F.col("rows"))
    place = spread.withColumn("place", F.explode(F.sequence(start, stop)))
    return place.select(group, column, ((F.col("below") + F.col("place")) / F.col("total")).alias("cdf"))


def review_activity(df: DataFrame) -> DataFrame:
    """Estimated reviews per month, walking back from each listing's last review at its monthly rate.

    Listings with equal month, count and rate take the same walk, so they are counted first and each
    walk is written out once with its weight.
    """
    day = parse_day(F.col("last_review"))
    rate = F.when(F.col("reviews_per_month") == 0, F.lit(1.0)).otherwise(F.col("reviews_per_month"))
    walks = (
        df.filter(day.isNotNull() & (F.col("number_of_reviews") > 0))
        .select(F.trunc(day, "MM").alias("last_month"), F.col("number_of_reviews").alias("n"), rate.alias("rate"))
        .groupBy("last_month", "n", "rate")
        .agg(F.count(F.lit(1)).alias("listings"))
    )
    steps = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("rate")) - 1)
    months = walks.withColumn("back", F.explode(steps)).select(
        F.add_months("last_month", -F.col("back").cast("int")).alias("month_start"),
        (F.col("listings") * F.least(F.col("rate"), F.col("n") - F.col("back") * F.col("rate"))).alias("reviews"),
    )
    return (
        months.groupBy(F.year("month_start").alias("year"), F.month("month_start").alias("month"))
        .agg(F.sum("reviews").alias("reviews"))
        .orderBy("year", "month")
    )


def activity_heatmap(activity: DataFrame, floor_share: float = 0.01) -> DataFrame:
    """Year by month, zero-filled; years below a hundredth of the largest year are left out."""
    months = [f"m{m:02d}" for m in range(1, 13)]
    wide = activity.groupBy("year").agg(
        *[F.sum(F.when(F.col("month") == i + 1, F.col("reviews")).otherwise(0.0)).alias(m) for i, m in enumerate(months)],
        F.sum("reviews").alias("__total"),
    )
    largest = F.max("__total").over(Window.partitionBy())
    return (
        wide.withColumn("__largest", largest)
        .filter(F.col("__total") >= F.col("__largest") * floor_share)
        .select("year", *months)
        .orderBy("year")
    )


def price_review_points(df: DataFrame, rows: int = 8000, room_types: Sequence[str] | None = None) -> DataFrame:
    """At most ``rows`` active listings per room type, moved by a small repeatable factor for plotting."""
    active = df.filter(F.col("number_of_reviews") > 0)
    if room_types is not None:
        active = active.filter(F.col("room_type").isin(*room_types))
    sample = capped_sample(active, "room_type", rows)

    def moved(column: str, spread: float, seed: int) -> Column:
        shift = (hash_uniform(F.col("id"), seed) * 2 - 1) * spread
        return F.col(column) * F.pow(F.lit(10.0), shift)

    return sample.select(
        "id",
        "room_type",
        "number_of_reviews",
        "price",
        moved("number_of_reviews", 0.04, 101).alias("x"),
        moved("price", 0.02, 202).alias("y"),
    )


def geo_density(df: DataFrame) -> DataFrame:
    """Listings per map cell and room type."""
    cell = geo_cell(F.col("latitude"), F.col("longitude"))
    return df.groupBy(cell.alias("geo_cell"), "room_type").agg(F.count(F.lit(1)).alias("rows"))


def geo_points(df: DataFrame) -> DataFrame:
    return df.select("id", "room_type", "latitude", "longitude", "price")


def display_rows(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Raw rows of the listings that survived cleaning, with their display columns."""
    return raw.join(kept.select("id"), "id", "left_semi").fillna({"reviews_per_month": 0.0})
