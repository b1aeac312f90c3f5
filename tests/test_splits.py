import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgecast.operators import splits
from lodgecast.plans.predictions import labelled
from lodgecast.sources.star import star_listings


def rows_of(spark, n=100):
    data = [
        (i, ["Bronx", "Brooklyn", "Manhattan", "Queens"][i % 4], ["Private room", "Entire home/apt"][i % 2],
         float(np.log1p(50 + 250 * i / (n - 1))))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id bigint, neighbourhood_group string, room_type string, label double")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_stratified_sample_is_repeatable_and_spread(spark):
    rows = rows_of(spark)
    first = splits.stratified_sample(rows, 20)
    chosen = ids(first)
    assert len(chosen) == 20
    for parts in (1, 4, 37):
        assert ids(splits.stratified_sample(rows.repartition(parts), 20)) == chosen
    assert first.select("neighbourhood_group").distinct().count() > 1
    assert first.select("room_type").distinct().count() > 1


def test_small_tables_are_taken_whole(spark):
    assert ids(splits.stratified_sample(rows_of(spark, 15), 800)) == list(range(15))


@pytest.mark.parametrize("n", [1, 3, 10, 103])
def test_folds_partition_the_rows(spark, n):
    rows = spark.range(n)
    sizes = {r["fold"]: r["count"] for r in splits.assign_folds(rows).groupBy("fold").count().collect()}
    assert [sizes.get(f, 0) for f in range(5)] == [n // 5 + (f < n % 5) for f in range(5)]


@pytest.mark.parametrize("n", [7, 100, 1234])
def test_exact_sizes(spark, n):
    rows = spark.range(n)
    assert splits.assign_split_exact(rows).filter("split = 'test'").count() == math.ceil(0.2 * n)
    assert splits.fraction_sample(rows).count() == round(0.35 * n)


def test_split_does_not_depend_on_partitions(spark):
    rows = spark.range(500)
    picked = [ids(splits.assign_split(rows.repartition(p)).filter("split = 'test'")) for p in (1, 4, 37)]
    assert picked[0] == picked[1] == picked[2] and 60 < len(picked[0]) < 140


def test_modes(spark, small):
    train = labelled(star_listings(spark, small)).filter("split = 'train'")
    n = train.count()
    assert splits.training_rows(train, "full").count() == n
    assert splits.training_rows(train, "sample").count() == round(0.35 * n)
    assert splits.training_rows(train, "lite", 100).count() == 100
    with pytest.raises(ValueError):
        splits.training_rows(train, "other")


def test_hot_stratum_is_trimmed_before_the_shuffle(spark):
    plan = splits.capped_sample(rows_of(spark), "room_type", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert splits.capped_sample(rows_of(spark), "room_type", 5).groupBy("room_type").agg(F.count("*")).count() == 2
