import numpy as np
import pytest
from test_learning import coordinate_descent

from lodgecast.learning import ensembles
from lodgecast.learning.search import encode, scaled, tune

COLUMNS = {"categorical": ["c"], "target_encoded": ["c"], "numeric": ["n"]}
FOLDS = 3
SETTINGS = {"ElasticNet": {"alpha": 0.02, "l1_ratio": 0.5, "max_iter": 10000, "tol": 1e-6},
            "KNN": {"n_neighbors": 4, "weights": "uniform", "leaf_size": 30}}


def plain_features(c, n, y, inside):
    names, mean = sorted(set(c[inside])), y[inside].mean()
    hot = np.array([[v == k for k in names] for v in c], float)
    means = {k: (y[inside][c[inside] == k].sum() + 10 * mean) / ((c[inside] == k).sum() + 10) for k in names}
    x = np.column_stack([hot, [means.get(v, mean) for v in c], n])
    deviation = x[inside].std(axis=0)
    return x / np.where(deviation > 1e-12, deviation, 1.0)


def plain_predictions(c, n, y, inside, outside):
    x = plain_features(c, n, y, inside)
    w, intercept = coordinate_descent(x[inside], y[inside], 0.01, 0.01)
    near = np.argsort(((x[outside][:, None] - x[inside][None]) ** 2).sum(axis=2), axis=1)[:, :4]
    return np.column_stack([x[outside] @ w + intercept, y[inside][near].mean(axis=1)])


def plain_score(c, n, y, fold):
    errors = []
    for f in range(FOLDS):
        train, held = fold != f, fold == f
        meta = np.zeros((len(y), 2))
        for g in set(range(FOLDS)) - {f}:
            meta[fold == g] = plain_predictions(c, n, y, train & (fold != g), fold == g)
        x, t = meta[train] - meta[train].mean(axis=0), y[train] - y[train].mean()
        w = np.linalg.solve(x.T @ x + np.eye(2), x.T @ t)
        base = plain_predictions(c, n, y, train, held)
        predicted = (base - meta[train].mean(axis=0)) @ w + y[train].mean()
        errors.append(np.sqrt(((y[held] - predicted) ** 2).mean()))
    return np.mean(errors)


def test_score_is_that_of_a_plain_nested_run(spark):
    random = np.random.default_rng(6)
    c, n, fold = random.choice(list("abcd"), 120), random.normal(0, 1, 120), np.arange(120) % FOLDS
    y = 4 + np.sin(2 * n) + np.array([{"a": 0, "b": 0.7, "c": -0.4, "d": 1.2}[v] for v in c]) + random.normal(0, 0.1, 120)
    rows = [(i, float(y[i]), int(fold[i]), str(c[i]), float(n[i])) for i in range(120)]
    train = spark.createDataFrame(rows, "id long, label double, fold int, c string, n double").repartition(2)
    test = train.filter("id < 20")
    encoded = scaled(encode(train, test, FOLDS, **COLUMNS))
    chosen = [tune(m, encoded, 1, overrides=p, log=lambda line: None) for m, p in SETTINGS.items()]
    found = ensembles.stack(chosen, test, train, FOLDS, **COLUMNS)
    assert found.cv_rmse_log == pytest.approx(plain_score(c, n, y, fold), rel=2e-3)
    with pytest.raises(ValueError, match="three folds"):
        ensembles.nested_predictions(train, chosen, 2, **COLUMNS)
