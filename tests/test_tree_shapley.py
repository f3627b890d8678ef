"""Shapley values of trees from their paths against all coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.classification import RandomForestClassifier

from colscope.operators import boosting as B, tree_shapley as TS
from colscope.operators.trees import Tree


def random_tree(draw, d, depth):
    feature, threshold, left, right, value, cover = [], [], [], [], [], []

    def node(k, n):
        at = len(feature)
        feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1), value.append(float(draw.normal())), cover.append(float(n))
        if k and n >= 2 and draw.random() < 0.85:
            feature[at], threshold[at] = int(draw.integers(d)), float(np.round(draw.normal(), 1))
            a = int(draw.integers(1, n))
            left[at], right[at] = node(k - 1, a), node(k - 1, n - a)
        return at

    node(depth, 1000)
    return Tree(*map(np.array, (feature, np.zeros(len(feature), int), threshold, left, right, value, cover)))


def given(t, x, known, node=0):
    """Mean of a tree when only the columns in ``known`` are there."""
    f = t.feature[node]
    if f < 0:
        return t.value[node]
    a, b = t.left[node], t.right[node]
    if f in known:
        return given(t, x, known, a if x[f] <= t.threshold[node] else b)
    return (t.cover[a] * given(t, x, known, a) + t.cover[b] * given(t, x, known, b)) / t.cover[node]


def exhaustive(trees, x, d):
    phi = np.zeros(d)
    for j in range(d):
        others = [i for i in range(d) if i != j]
        for s in range(d):
            for on in combinations(others, s):
                w = factorial(s) * factorial(d - s - 1) / factorial(d)
                phi[j] += w * sum(given(t, x, {*on, j}) - given(t, x, set(on)) for t in trees)
    return phi


@pytest.mark.parametrize("d,depth", [(1, 3), (4, 3), (6, 6), (8, 5), (10, 4)])
def test_equal_to_all_coalitions(d, depth, monkeypatch):
    monkeypatch.setattr(TS, "CELLS", 50)
    draw = np.random.default_rng(d)
    trees = [random_tree(draw, d, depth) for _ in range(3)]
    x = np.round(draw.normal(size=(5, d)), 1)
    paths, mean = TS.leaf_paths(trees)
    got = TS.path_values(x, paths, d)
    assert np.allclose(got, [exhaustive(trees, a, d) for a in x])
    assert np.allclose(got.sum(axis=1) + mean, sum(t.predict(x) for t in trees))


def test_many_columns_add_up():
    draw = np.random.default_rng(3)
    trees = [random_tree(draw, 100, 9) for _ in range(20)]
    x = draw.normal(size=(40, 100))
    paths, mean = TS.leaf_paths(trees)
    assert np.allclose(TS.path_values(x, paths, 100).sum(axis=1) + mean, sum(t.predict(x) for t in trees))


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 4))
    y = x[:, 0] * 2 + x[:, 1] * x[:, 2]
    return spark.createDataFrame([(i, i % 3, float(v), a.tolist()) for i, (a, v) in enumerate(zip(x, y))], "key long, fold int, label double, x array<double>").withColumn("features", array_to_vector("x"))


def test_spark_models(spark, rows):
    for est in (DecisionTreeRegressor(maxDepth=4), RandomForestRegressor(numTrees=5, maxDepth=4, seed=1), GBTRegressor(maxIter=4, maxDepth=3, seed=1)):
        model = est.fit(rows)
        phi, mean = TS.tree_shapley(rows, model)
        for r in phi.join(model.transform(rows), "key").collect():
            assert sum(r["phi"]) + mean == pytest.approx(r["prediction"])
        assert mean == pytest.approx(rows.agg({"label": "avg"}).first()[0], abs=0.3)


def test_own_models_and_classes(spark, rows):
    model = B.fit_many(rows, [(B.Boosting(rounds=6, max_depth=3), None)])[0]
    phi, mean = TS.tree_shapley(rows, model)
    got = phi.join(rows, "key").collect()
    assert np.allclose([sum(r["phi"]) + mean for r in got], model.predict(np.array([r["x"] for r in got])))
    assert np.abs(np.array([r["phi"][3] for r in got])).mean() < 0.3 * np.abs(np.array([r["phi"][0] for r in got])).mean()
    extra = B.fit_extra_trees(rows, 5, 4)
    phi, mean = TS.tree_shapley(rows, extra)
    got = phi.join(rows, "key").collect()
    assert np.allclose([sum(r["phi"]) + mean for r in got], extra.predict(np.array([r["x"] for r in got])))
    two = rows.withColumn("label", (rows["label"] > 0).cast("double"))
    forest = RandomForestClassifier(numTrees=4, maxDepth=3, seed=1).fit(two)
    phi, mean = TS.tree_shapley(two, forest, 1)
    for r in phi.join(forest.transform(two), "key").collect():
        assert sum(r["phi"]) + mean == pytest.approx(r["probability"][1])
