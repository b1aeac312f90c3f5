import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lodgecast.learning import dense_net, descent, kernel_svr, regressors
from lodgecast.learning.features import PopulationScaler, TargetMeanEncoder, feature_names, feature_pipeline
from lodgecast.operators.encoding import scale_columns, target_means_by_fold


def linear_data(spark, n=400, seed=1):
    random = np.random.default_rng(seed)
    x = random.normal(0, 1, (n, 3)) * [1.0, 2.0, 0.5]
    y = 3.0 + x @ [1.0, -0.5, 0.0] + random.normal(0, 0.3, n)
    rows = [(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["id", "features", "label"]).repartition(4)


def coordinate_descent(x, y, l1, l2, sweeps=2000):
    mean_x, mean_y = x.mean(axis=0), y.mean()
    xc, yc, w = x - mean_x, y - mean_y, np.zeros(x.shape[1])
    for _ in range(sweeps):
        for j in range(len(w)):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / ((xc[:, j] ** 2).mean() + l2)
    return w, mean_y - mean_x @ w


@pytest.mark.parametrize("l1,l2", [(0.1, 0.0), (0.0, 0.5), (0.05, 0.2), (0.0, 0.0)])
def test_penalties_mean_what_they_say(spark, l1, l2):
    x, y, rows = linear_data(spark)
    _, deviation = regressors.label_deviation(rows)
    fitted = regressors.penalised_linear(l1, l2, deviation, 1000, 1e-10).fit(rows)
    w, intercept = coordinate_descent(x, y, l1, l2)
    np.testing.assert_allclose(fitted.coefficients.toArray(), w, atol=1e-4)
    assert fitted.intercept == pytest.approx(intercept, abs=1e-4)


def test_ridge_is_the_closed_form(spark):
    x, y, rows = linear_data(spark)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 25.0 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(regressors.ridge(25.0, rows).fit(rows).coefficients.toArray(), w, atol=1e-6)


def test_search_bounds_and_fixed_parameters():
    for trial in range(20):
        svm = regressors.draw_params("SVM", trial)
        assert 0.05 <= svm["C"] <= 1.0 and 0.3 <= svm["epsilon"] <= 0.8 and svm["gamma"] == "scale"
        knn = regressors.draw_params("KNN", trial)
        assert knn["p"] == 2 and 3 <= knn["n_neighbors"] <= 80
        net = regressors.draw_params("NeuralNetwork", trial)
        assert net["hidden_layer_name"] in dense_net.HIDDEN_LAYERS and net["max_iter"] % 200 == 0
        boosted = regressors.draw_params("XGBoost", trial)
        assert boosted["n_estimators"] % 50 == 0 and 3 <= boosted["max_depth"] <= 12
    assert regressors.draw_params("SVM", 3) == regressors.draw_params("SVM", 3)
    assert regressors.draw_params("SVM", 3) != regressors.draw_params("SVM", 4)


def test_tree_parameters(spark):
    forest = regressors.random_forest(
        {"n_estimators": 200, "max_depth": 28, "min_samples_split": 20, "min_samples_leaf": 3, "max_features": "None"}
    )
    assert (forest.getNumTrees(), forest.getMinInstancesPerNode(), forest.getFeatureSubsetStrategy()) == (200, 10, "all")


def categories(spark):
    rows = [(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0), (4, None, 7.0)]
    return spark.createDataFrame(rows, "id bigint, c string, label double")


def test_target_means(spark, tmp_path):
    model = TargetMeanEncoder(inputCols=["c"]).fit(categories(spark))
    new = spark.createDataFrame([(1, "a"), (2, "unseen"), (3, None)], "id bigint, c string")
    expected = {1: (4.0 + 40.0) / 12, 2: 4.0, 3: (7.0 + 40.0) / 11}
    got = {r["id"]: r["c_target_mean"] for r in model.transform(new).collect()}
    assert got == pytest.approx(expected)
    PipelineModel([model]).write().overwrite().save(f"{tmp_path}/m")
    loaded = PipelineModel.load(f"{tmp_path}/m")
    assert {r["id"]: r["c_target_mean"] for r in loaded.transform(new).collect()} == got


def test_target_means_by_fold_use_the_other_folds_only(spark):
    rows = categories(spark).withColumn("fold", (F.col("id") % 2).cast("int"))
    got = {(r["fold"], r["category"]): r["target_mean"] for r in target_means_by_fold(rows, ["c"], 2).collect()}
    assert got == pytest.approx({(0, "a"): (1.0 + 30.0) / 11, (0, "b"): (5.0 + 30.0) / 11,
                                 (1, "a"): (3.0 + 50.0) / 11, (1, None): (7.0 + 50.0) / 11})


def test_unknown_categories_are_all_zeros_and_names_are_kept(spark):
    stages = feature_pipeline(categorical=["c"], target_encoded=["c"], numeric=["n"])
    train = categories(spark).withColumn("c", F.coalesce("c", F.lit("nan"))).withColumn("n", F.lit(2.0))
    model = stages.fit(train)
    new = spark.createDataFrame([(1, "unseen", 5.0), (2, "b", 5.0)], "id bigint, c string, n double")
    out = model.transform(new).orderBy("id")
    assert [r["features"].toArray()[:3].tolist() for r in out.collect()] == [[0, 0, 0], [0, 1, 0]]
    assert feature_names(out) == ["c_onehot_a", "c_onehot_b", "c_onehot_nan", "c_target_mean", "n"]


def test_scalers_use_the_population_deviation(spark):
    values = np.array([[1.0, 5.0], [2.0, 5.0], [6.0, 5.0]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(values)], "id int, a double, b double")
    got = scale_columns(df, ["a", "b"]).orderBy("id").toPandas()
    np.testing.assert_allclose(got["a"], (values[:, 0] - 3) / values[:, 0].std())
    np.testing.assert_allclose(got["b"], 0.0)
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df)
    scaled = PopulationScaler(inputCol="v", outputCol="s").fit(vectors).transform(vectors).orderBy("id").collect()
    np.testing.assert_allclose([r["s"].toArray() for r in scaled], values / [values[:, 0].std(), 1.0])


def test_network_gradient_matches_differences():
    random = np.random.default_rng(4)
    for activation in ("relu", "tanh"):
        shapes = [(3, 4), (4, 1)]
        flat, x, y = random.normal(0, 1, 21), random.normal(0, 1, (8, 3)), random.normal(0, 1, 8)
        loss = dense_net.squared_loss(shapes, activation)
        _, slope = loss(flat, x, y)
        for i in range(21):
            step = np.zeros(21)
            step[i] = 1e-6
            assert slope[i] == pytest.approx((loss(flat + step, x, y)[0] - loss(flat - step, x, y)[0]) / 2e-6, abs=1e-5)


def test_training_does_not_depend_on_partitions(spark):
    """Two models, laid out in 2, 24 and 200 partitions: the same losses. The last adds up its sums in tasks."""
    _, _, rows = linear_data(spark, n=900)
    for make in (
        lambda: dense_net.DenseNetRegressor(hiddenLayers=[6], learningRate=0.02, batchSize=16, maxIter=3, steps=2),
        lambda: kernel_svr.KernelTubeRegressor(C=1.0, epsilon=0.1, components=32, maxIter=3, batchSize=32, steps=2),
    ):
        histories = [make().fit(rows.repartition(n)).history for n in (2, 24, 200)]
        np.testing.assert_allclose(histories[1], histories[0], rtol=1e-6)
        np.testing.assert_allclose(histories[2], histories[0], rtol=1e-6)


def test_steps_are_those_of_a_plain_run(spark):
    """One step for each round over all rows: the losses of the same steps in numpy."""
    x, y, rows = linear_data(spark, n=200)
    shapes = [(3, 5), (5, 1)]
    settings = descent.Descent(0.05, 16, 6, steps=1)
    start = np.random.default_rng(8).normal(0, 0.5, 26)
    loss, decay = dense_net.squared_loss(shapes, "tanh"), dense_net.weight_decay(shapes, 2.0)
    got, history, settled = descent.descend(descent.training_rows(rows), start, loss, decay, settings)
    w, first, second, want = start.copy(), 0.0, 0.0, []
    for t in range(1, 7):
        value, slope = loss(w, x, y)
        want.append(value / 200)
        slope = slope / 200
        slope[:15] += 0.01 * w[:15]
        slope[20:25] += 0.01 * w[20:25]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    np.testing.assert_allclose(history, want, rtol=1e-9)
    np.testing.assert_allclose(got, w, rtol=1e-7)
    assert not settled


def test_sparse_and_dense_vectors_give_the_same_blocks(spark, monkeypatch):
    monkeypatch.setattr(descent, "BLOCK_CELLS", 12)  # four rows at a time
    x = np.random.default_rng(2).normal(0, 1, (37, 3)) * (np.arange(37 * 3).reshape(37, 3) % 2)
    vectors = [Vectors.dense(v) if i % 3 else Vectors.sparse(3, [(j, v[j]) for j in range(3) if v[j]]) for i, v in enumerate(x)]
    rows = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(vectors)], ["id", "features", "label"])

    def plain(weights, block, y):
        return float(y.sum()), block.T @ y

    n, loss, slope = descent.summed(descent.training_rows(rows.repartition(2)), np.zeros(3), plain, 4)
    assert (n, loss) == (37, 36 * 37 / 2)
    np.testing.assert_allclose(slope, x.T @ np.arange(37))


def test_every_partition_works_in_every_step(spark):
    """No layout by key: each task that holds rows gives a sum of its own."""
    _, _, rows = linear_data(spark, n=900)
    spread = descent.training_rows(rows.repartition(12))
    half = spread.filter("place < 0.5")
    tasks = half.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 12


def test_network_learns_clips_and_reloads(spark, tmp_path):
    _, y, rows = linear_data(spark)
    model = dense_net.DenseNetRegressor(hiddenLayers=[8], learningRate=0.02, batchSize=16, maxIter=15, activation="tanh").fit(rows)
    assert model.history[-1] < 0.5 * model.history[0]
    predicted = model.transform(rows).select("id", "label", "prediction").toPandas()
    assert ((predicted["label"] - predicted["prediction"]) ** 2).mean() < 0.4 * y.var()
    PipelineModel([model]).write().overwrite().save(f"{tmp_path}/net")
    again = PipelineModel.load(f"{tmp_path}/net").transform(rows).select("id", "prediction").toPandas()
    np.testing.assert_allclose(again.sort_values("id")["prediction"], predicted.sort_values("id")["prediction"])
    model.weights = np.zeros_like(model.weights)
    model.weights[-1] = 100.0
    assert set(model.transform(rows).toPandas()["prediction"]) == {y.max()}


def test_kernel_regression_beats_the_mean_and_reloads(spark, tmp_path):
    random = np.random.default_rng(5)
    x = random.normal(0, 1, (600, 2))
    y = np.sin(x[:, 0]) + 0.1 * random.normal(0, 1, 600)
    rows = spark.createDataFrame(
        [(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["id", "features", "label"]
    ).repartition(4)
    model = kernel_svr.KernelTubeRegressor(C=1.0, epsilon=0.1, components=200, maxIter=25, batchSize=32).fit(rows)
    predicted = model.transform(rows).toPandas()
    assert ((predicted["label"] - predicted["prediction"]) ** 2).mean() < 0.3 * y.var()
    assert model.gamma == 0.5
    PipelineModel([model]).write().overwrite().save(f"{tmp_path}/svr")
    again = PipelineModel.load(f"{tmp_path}/svr").transform(rows).toPandas()
    np.testing.assert_allclose(again.sort_values("id")["prediction"], predicted.sort_values("id")["prediction"])
