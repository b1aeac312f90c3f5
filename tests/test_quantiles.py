import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodgecast.functions.quantiles import from_bits, grouped_quantiles, ordered_bits, quantile_array, quantile_edges, with_bands


def skewed(spark, n=30_000, partitions=5):
    """A third of the rows in one group and a third of those the same value."""
    random = np.random.default_rng(3)
    values = np.exp(random.normal(4, 1, n))
    groups = np.where(np.arange(n) % 3 == 0, "hot", np.char.add("g", (np.arange(n) % 7).astype(str)))
    values[np.arange(n) % 9 == 0] = 55.5
    table = pd.DataFrame({"k": groups, "v": values, "w": -values**0.5, "i": (values * 3).astype("int64")})
    return table, spark.createDataFrame(table).repartition(partitions)


@pytest.mark.parametrize("bits,few", [(16, 1 << 16), (16, 10), (7, 1), (5, 300)])
def test_grouped_quantiles_are_exact(spark, bits, few):
    table, df = skewed(spark)
    wanted = {"a": ("v", 0.5), "b": ("v", 0.9), "c": ("w", 0.25), "d": ("v", 0.0), "e": ("w", 1.0)}
    extra = [F.avg("v").alias("mean_v")]
    got = grouped_quantiles(df, ["k"], wanted, extra, bits, few).toPandas().set_index("k").sort_index()
    groups = table.groupby("k")
    for name, (column, p) in wanted.items():
        np.testing.assert_allclose(got[name], groups[column].quantile(p).sort_index(), rtol=1e-12)
    np.testing.assert_allclose(got["mean_v"], groups["v"].mean().sort_index(), rtol=1e-12)


@pytest.mark.parametrize("few", [2, 1 << 16])
def test_whole_table_quantiles(spark, few):
    table, df = skewed(spark)
    got = grouped_quantiles(df, [], {"a": ("v", 1 / 3), "b": ("w", 0.5)}, [F.count("v").alias("n")], few=few).first()
    assert got["a"] == pytest.approx(table["v"].quantile(1 / 3), rel=1e-12)
    assert got["b"] == pytest.approx(table["w"].quantile(0.5), rel=1e-12)
    assert got["n"] == len(table)


ODD_DOUBLES = [
    0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-300, 0.1, 1 / 3, 0.9999999999999999, 1.0, 1.0000000000000002,
    1.9999999999999998, 2.0, 3.0, 1023.9999999999999, 1024.0, 2.0**53 - 1, 2.0**53, 1e22, 1e300, 1.7976931348623157e308, float("inf"),
]


def test_bits_keep_the_order_of_doubles(spark):
    random = np.random.default_rng(8)
    some = random.integers(0, 0x7FF0000000000000, 3_000).view(np.float64).tolist() + (2.0 ** np.arange(-1074, 1024)).tolist()
    values = [*ODD_DOUBLES, *some]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("bits"))
    for r in df.withColumn("back", from_bits(F.col("bits"))).collect():
        assert r["back"] == r["v"]
        raw = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["bits"] == (-raw if r["v"] < 0 else raw), r


def test_far_apart_and_odd_values(spark):
    values = sorted([*ODD_DOUBLES, *[-v for v in ODD_DOUBLES[1:]], *[7.25] * 60, *[-0.0] * 5])
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for few in (1, 8, 1 << 16):
        probs = [i / (len(values) - 1) for i in range(0, len(values), 9)]
        found = quantile_array(df, "v", probs, few=few).first()["q"]
        assert found == pytest.approx([values[i] for i in range(0, len(values), 9)], rel=1e-12)
    last = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),)], "v double")
    found = quantile_array(last, "v", [0.0, 0.5, 1.0]).first()["q"]
    assert found[:2] == [float("-inf"), 1.0] and found[2] != found[2]


def test_a_hot_value_is_counted_and_not_ranked(spark):
    df = spark.range(0, 200_000, 1, 6).select(F.when(F.col("id") % 3 == 0, 12.5).otherwise(F.sqrt(F.col("id") + 1.0)).alias("v"))
    table = df.toPandas()["v"]
    found = quantile_array(df, "v", [0.01, 0.3, 0.5, 0.99], few=100).first()["q"]
    np.testing.assert_allclose(found, table.quantile([0.01, 0.3, 0.5, 0.99]), rtol=1e-12)


def test_whole_numbers(spark):
    table, df = skewed(spark)
    got = quantile_array(df, "i", [0.25, 0.5, 0.9]).first()["q"]
    np.testing.assert_allclose(got, table["i"].quantile([0.25, 0.5, 0.9]))


def test_groups_without_values_stay(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None), (None, 4.0), (None, 8.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["q"]) for r in grouped_quantiles(df, ["k"], {"q": ("v", 0.75)}, [F.count("*").alias("n")]).collect()}
    assert got == {"a": (1, None), "b": (2, 1.0), None: (2, 7.0)}


@pytest.mark.parametrize("values", [[1.0, 1.0, 1.0, 2.0, 3.0, 4.0], [5.0] * 6, list(np.linspace(50, 300, 97)), [1.0, 2.0]])
@pytest.mark.parametrize("bands", [2, 5, 10])
def test_bands_like_pandas(spark, values, bands):
    expected = pd.qcut(pd.Series(values), q=bands, labels=False, duplicates="drop")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
    got = [r["band"] for r in with_bands(df, "v", bands).orderBy("id").collect()]
    assert got == [None if pd.isna(b) else int(b) for b in expected]


def test_equal_edges_raise_where_they_must_not_merge(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "v double")
    with pytest.raises(ValueError, match="unique"):
        quantile_edges(df, "v", 3, drop_equal=False)


def test_empty_input(spark):
    df = spark.createDataFrame([], "v double")
    assert quantile_edges(df, "v", 3) == []
    assert with_bands(df, "v", 3).count() == 0
