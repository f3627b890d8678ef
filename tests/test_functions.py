import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from colscope.functions import metrics as M
from colscope.functions.keys import below, fold, hex_bound, is_test
from colscope.operators.dcor import concordant, mean_distances
from colscope.operators.shapley import coalition_weights, hash_normal, permutation_weights

floats = st.lists(st.integers(-20, 20).map(float), min_size=2, max_size=40)


@given(floats, st.randoms())
@settings(max_examples=50, deadline=None)
def test_concordant_equals_double_loop(x, rnd):
    y = [float(rnd.randint(-9, 9)) for _ in x]
    want = sum((a - c) * (b - d) for a, b in zip(x, y) for c, d in zip(x, y) if c < a and d < b)
    assert concordant(np.array(x), np.array(y)) == pytest.approx(want)


@given(floats)
@settings(max_examples=50, deadline=None)
def test_mean_distances(x):
    v = np.array(x)
    assert np.allclose(mean_distances(v, len(v), v.sum()), np.abs(v[:, None] - v[None]).mean(axis=1))


@pytest.mark.parametrize("d", [1, 3, 5])
def test_shapley_weights_are_exact_for_any_game(d):
    rng = np.random.default_rng(d)
    masks, coefs = coalition_weights(d)
    worth = {tuple(m): rng.normal() for m in masks}
    phi = sum(worth[tuple(m)] * c for m, c in zip(masks, coefs))
    assert phi.sum() == pytest.approx(worth[tuple(np.ones(d))] - worth[tuple(np.zeros(d))])
    masks2, coefs2 = permutation_weights(d, 4000, 1)
    phi2 = sum(worth[tuple(m)] * c for m, c in zip(masks2, coefs2))
    assert np.abs(phi - phi2).max() < 0.15


def test_noise_is_normal_and_fixed_by_key():
    a = hash_normal(np.arange(50_000), 3, 2)
    assert abs(a.mean()) < 0.02 and abs(a.std() - 1) < 0.02 and abs(np.corrcoef(a.T)[0, 1]) < 0.02
    assert np.array_equal(a[10:20], hash_normal(np.arange(10, 20), 3, 2))
    assert abs(np.corrcoef(a[:, 0], hash_normal(np.arange(50_000), 4, 1)[:, 0])[0, 1]) < 0.02


def test_split_is_fixed_by_key(spark):
    df = spark.range(4000).select("id", is_test("id").alias("t"), fold("id").alias("f"))
    got = df.toPandas()
    want = [hashlib.md5(f"1:{i}".encode()).hexdigest()[:8] < hex_bound(0.3) for i in got["id"]]
    assert list(got["t"]) == want
    assert abs(got["t"].mean() - 0.3) < 0.03
    assert np.abs(got["f"].value_counts(normalize=True) - 1 / 3).max() < 0.03
    assert spark.range(100).where(below("id", 1.0)).count() == 100
    assert spark.range(100).where(below("id", 0.0)).count() == 0


def test_metrics_skip_rows_without_prediction(spark):
    pdf = pd.DataFrame({"g": 0, "y": [1.0, 2.0, 3.0, 100.0], "p": [1.5, 2.0, 2.0, None]})
    row = M.regression_metrics(spark.createDataFrame(pdf).withColumn("p", F.when(~F.isnan("p"), F.col("p"))), ["g"]).first()
    y, p = np.array([1.0, 2, 3]), np.array([1.5, 2, 2])
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["RMSE"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row["MAPE"] == pytest.approx((np.abs(y - p) / y).mean())


def test_scorers(spark):
    assert M.resolve_scorer(M.mae) is M.mae
    with pytest.raises(ValueError):
        M.resolve_scorer("nothing")
