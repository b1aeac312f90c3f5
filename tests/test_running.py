"""Running totals with groups spread over many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgecast.functions.running import running_total
from lodgecast.operators import charts


@pytest.fixture(params=[True, False])
def many_parts(spark, request):
    """Parts as they come out of the shuffle, or merged by the planner."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param).lower())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_group_over_many_parts(spark, many_parts):
    draw = np.random.default_rng(4)
    rows = [("hot", int(v), int(n)) for v, n in zip(draw.permutation(4_000), draw.integers(0, 9, 4_000))]
    rows += [(None, v, v) for v in range(5)] + [("one", 7, 3), ("low", -1, 1), ("low", -2, 1)]
    got = running_total(spark.createDataFrame(rows, "g string, v int, n bigint"), "g", "v", "n")
    seen, totals = {}, {}
    for g, _, n in rows:
        totals[g] = totals.get(g, 0) + n
    for r in sorted(got.collect(), key=lambda r: (r["g"] or "", r["v"])):
        assert (r["below"], r["total"]) == (seen.get(r["g"], 0), totals[r["g"]])
        seen[r["g"]] = seen.get(r["g"], 0) + r["n"]
    assert seen == totals


def test_cumulative_curve_of_a_hot_group(spark, many_parts):
    df = spark.range(0, 3_000, 1, 5).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("k"), (F.col("id") * 7919 % 1009).alias("v")
    )
    got = charts.cumulative_points(df, "k", "v").toPandas()
    table = df.toPandas()
    for k, own in table.groupby("k"):
        curve = got[got["k"] == k].sort_values("cdf")
        np.testing.assert_array_equal(curve["v"], np.sort(own["v"]))
        np.testing.assert_allclose(curve["cdf"], np.arange(1, len(own) + 1) / len(own))


def test_empty(spark):
    assert running_total(spark.createDataFrame([], "g string, v int, n bigint"), "g", "v", "n").count() == 0
