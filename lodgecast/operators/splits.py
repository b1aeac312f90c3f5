"""Train/test split, folds and samples, all in seeded hash order of the row key."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodgecast import schema as S
from lodgecast.functions.lookups import join_lookup, sized
from lodgecast.functions.quantiles import with_bands
from lodgecast.functions.ranks import before, hash_places
from lodgecast.functions.scalars import hash_number, hash_text, joined_key

BUCKETS = 1000


def assign_split(df: DataFrame, test_share: float = S.TEST_SHARE, seed: int = S.SEED, key: str = "id") -> DataFrame:
    """Add ``split`` from the row key alone: no shuffle, the same for any partitioning."""
    test = hash_number(F.col(key), seed) % BUCKETS < F.lit(round(test_share * BUCKETS))
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def assign_split_exact(df: DataFrame, test_share: float = S.TEST_SHARE, seed: int = S.SEED, key: str = "id") -> DataFrame:
    """Add ``split`` with exactly the rounded-up share of test rows: those before one place of the hash order."""
    cut = hash_places(df, lambda total: [math.ceil(total * test_share)], key, seed)[0]
    return df.withColumn("split", F.when(before(cut, key, seed), F.lit("test")).otherwise(F.lit("train")))


def fold_starts(total: int, folds: int) -> list[int]:
    """Rank at which each fold but the first starts; sizes differ by one at most, the larger come first."""
    return [f * (total // folds) + min(f, total % folds) for f in range(1, folds)]


def assign_folds(df: DataFrame, folds: int = S.FOLDS, seed: int = S.SEED, key: str = "id") -> DataFrame:
    """Add ``fold`` 0..folds-1, a shuffled split into folds of equal size."""
    starts = hash_places(df, lambda total: fold_starts(total, folds), key, seed)
    fold = F.lit(folds - 1)
    for f in range(folds - 2, -1, -1):
        fold = F.when(before(starts[f], key, seed), F.lit(f)).otherwise(fold)
    return df.withColumn("fold", fold)


def fraction_sample(df: DataFrame, share: float = S.SAMPLE_SHARE, seed: int = S.SEED, key: str = "id") -> DataFrame:
    """Exactly ``round(share * rows)`` rows (half to even), the first in hash order."""
    cut = hash_places(df, lambda total: [round(total * share)], key, seed)[0]
    return df.filter(before(cut, key, seed))


def capped_sample(df: DataFrame, group: str, rows: int, seed: int = S.SEED, key: str = "id") -> DataFrame:
    """At most ``rows`` rows per group. The rank limit is applied before the shuffle, so that a hot
    group sends at most ``rows`` rows from each task."""
    order = Window.partitionBy(group).orderBy(hash_text(F.col(key), seed), key)
    return df.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= rows)


def with_strata(train: DataFrame, label: str = "label", bands: int = 5) -> DataFrame:
    """Add ``stratum``: borough, room type and price band of the row."""
    banded = with_bands(train, label, bands)
    key = F.concat(
        joined_key(F.col("neighbourhood_group"), F.col("room_type")),
        F.lit("__p"),
        F.coalesce(F.col("band").cast("string"), F.lit(S.MISSING_TEXT)),
    )
    return banded.withColumn("stratum", key).drop("band", "band_lo", "band_hi")


def allocate(strata: DataFrame, target_rows: int) -> DataFrame:
    """Largest-remainder share of ``target_rows`` per stratum: ``stratum, n, allocation``.

    Windows run over the stratum table only (boroughs x room types x bands), never over listings.
    """
    counts = strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    size = F.least(F.lit(target_rows), F.col("total"))
    exact = F.col("n") * size / F.col("total")
    by_remainder = Window.orderBy(F.desc("remainder"), "stratum")
    floors = (
        counts.withColumn("total", F.sum("n").over(everything))
        .withColumn("base", F.floor(exact))
        .withColumn("remainder", F.round(exact - F.floor(exact), 9))
        .withColumn("open", size - F.sum("base").over(everything))
        .withColumn("place", F.row_number().over(by_remainder))
    )
    extra = F.when(F.col("place") <= F.col("open"), 1).otherwise(0)
    return floors.select("stratum", "n", F.least(F.col("n"), F.col("base") + extra).alias("allocation"))


def stratified_sample(train: DataFrame, target_rows: int = S.LITE_ROWS, seed: int = S.SEED, key: str = "id") -> DataFrame:
    """A small representative sample: proportional strata, hash order inside each stratum.

    No stratum can need more than ``target_rows`` rows, so a rank limit trims hot strata before the
    shuffle and the allocation decides among what is left.
    """
    strata = with_strata(train)
    shares = sized(allocate(strata, target_rows)).select("stratum", "allocation")
    order = Window.partitionBy("stratum").orderBy(hash_text(F.col(key), seed), key)
    first = strata.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= target_rows)
    chosen = join_lookup(first, shares, ["stratum"], "inner").filter(F.col("pick") <= F.col("allocation"))
    return chosen.drop("pick", "allocation", "stratum")


def training_rows(train: DataFrame, mode: str, lite_rows: int = S.LITE_ROWS) -> DataFrame:
    """Training rows of a mode; test rows are never sampled."""
    if mode == "full":
        return train
    if mode == "sample":
        return fraction_sample(train)
    if mode == "lite":
        return stratified_sample(train, lite_rows)
    raise ValueError(f"unknown mode {mode!r}")
