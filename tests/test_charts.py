import numpy as np
import pandas as pd
import pytest

from lodgecast.operators import charts, dummies, profile


def test_cumulative_points_are_cut_into_chunks(spark):
    prices = [5] * 10 + [7] * 3 + [9]
    df = spark.createDataFrame([("A", p) for p in prices] + [("B", 1)], "room_type string, price bigint")
    got = charts.cumulative_points(df, "room_type", "price", chunk=4).toPandas().sort_values(["room_type", "cdf"])
    assert got[got.room_type == "A"]["price"].tolist() == prices
    np.testing.assert_allclose(got[got.room_type == "A"]["cdf"], np.arange(1, 15) / 14)
    assert got[got.room_type == "B"]["cdf"].tolist() == [1.0]


def test_histogram_like_numpy(spark):
    values = np.array([0.0, 0.5, 1.0, 3.0, 9.99, 10.0, 10.0])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    expected, edges = np.histogram(values, bins=50)
    got = charts.histogram(df, "v").toPandas()
    assert got["rows"].tolist() == expected.tolist()
    np.testing.assert_allclose(got["bin_lo"], edges[:-1])
    flat = charts.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).toPandas()
    assert flat["rows"].tolist() == np.histogram([2.0, 2.0], bins=4)[0].tolist()


def test_density_is_one_curve_per_large_group(spark):
    values = [1, 2, 2, 3, 5, 8, 13, 21, 34, 55, 89]
    df = spark.createDataFrame([("A", v) for v in values] + [("B", v) for v in range(10)], "g string, v int")
    got = charts.density(df, "g", "v", points=400).toPandas()
    assert set(got["g"]) == {"A"}
    h = np.std(values, ddof=1) * len(values) ** -0.2
    z = (got["x"].to_numpy()[:, None] - np.array(values)[None, :]) / h
    np.testing.assert_allclose(got["density"], np.exp(-z * z / 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi)))
    assert np.trapezoid(got["density"], got["x"]) == pytest.approx(1.0, abs=0.01)


def walk_back(rows):
    """Month totals by subtracting one month at a time."""
    total = {}
    for last, n, rate in rows:
        rate = rate or 1.0
        month, left = pd.Period(last, "M"), float(n)
        while left > 1e-9:
            total[month] = total.get(month, 0.0) + min(rate, left)
            left -= min(rate, left)
            month -= 1
    return total


def test_review_activity_walks_back(spark):
    rows = [("2019-03-31", 5, 2.0), ("2019-03-30", 5, 2.0), ("2019-01-15", 3, 0.0), ("2018-12-31", 1, 4.0), ("2019-05-01", 7, 0.3)]
    df = spark.createDataFrame(rows, "last_review string, number_of_reviews bigint, reviews_per_month double")
    got = {(r["year"], r["month"]): r["reviews"] for r in charts.review_activity(df).collect()}
    expected = {(m.year, m.month): v for m, v in walk_back(rows).items()}
    assert set(got) == set(expected)
    for key, value in expected.items():
        assert got[key] == pytest.approx(value)


def test_heatmap_drops_small_years_and_fills_months(spark):
    rows = [(2019, 5, 1000.0), (2018, 1, 10.0), (2017, 12, 9.9)]
    heat = charts.activity_heatmap(spark.createDataFrame(rows, "year int, month int, reviews double")).collect()
    assert [r["year"] for r in heat] == [2018, 2019]
    assert heat[1]["m05"] == 1000.0 and heat[1]["m06"] == 0.0


def test_box_whiskers_end_at_data(spark):
    values = [1, 10, 11, 12, 13, 14, 15, 40]
    df = spark.createDataFrame([("A", v) for v in values], "g string, v int")
    box = charts.box_stats(df, "g", "v").first()
    q1, q3 = np.percentile(values, [25, 75])
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (box["whisker_lo"], box["whisker_hi"], box["outliers"]) == (min(inside), max(inside), len(values) - len(inside))


def test_correlations_skip_rows_with_a_missing_value_of_the_pair(spark):
    rows = [(1.0, 2.0, None), (2.0, None, 1.0), (3.0, 5.0, 4.0), (4.0, 4.0, 9.0), (7.0, 1.0, 2.0)]
    got = profile.correlations(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    expected = pd.DataFrame(rows, columns=["a", "b", "c"]).corr()
    for r in got.collect():
        assert r["r"] == pytest.approx(expected.loc[r["column_a"], r["column_b"]])


def test_describe_like_pandas(spark):
    values = pd.DataFrame({"a": [1.0, 2.0, 4.0, 8.0], "b": [1, 1, 2, 50]})
    got = profile.describe(spark.createDataFrame(values), ["a", "b"]).toPandas().set_index("column").T
    np.testing.assert_allclose(got.to_numpy().astype(float), values.describe().to_numpy())


def test_indicators(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id int, t string")
    assert dummies.indicators(df, "t", drop_first=True).columns == ["id", "t_b", "t_c"]
    assert [tuple(r) for r in dummies.indicators(df, "t", "x").orderBy("id").collect()] == [
        (1, 0, 1, 0), (2, 1, 0, 0), (3, 0, 0, 0), (4, 0, 0, 1)
    ]
