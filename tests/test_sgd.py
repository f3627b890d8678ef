"""Stochastic gradient regression, kernel features and the refinement's ensembles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector

from colscope.operators import refine as RF, sgd
from colscope.operators.refine import Candidate


def rows_of(spark, x, y):
    pdf = pd.DataFrame({"key": np.arange(len(y)), "x": list(x), "label": y, "fold": np.arange(len(y)) % 3})
    return spark.createDataFrame(pdf, "key long, x array<double>, label double, fold int").repartition(3).withColumn("features", array_to_vector("x"))


@pytest.fixture(scope="module")
def planted(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 3)) * [1, 20, 0.1] + [5, -100, 0]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + 7 + draw.normal(size=3000)
    return x, y, rows_of(spark, x, y).persist()


def test_squared_loss_meets_the_closed_form(planted):
    x, y, rows = planted
    b, w = sgd.fit_descent(rows, sgd.Descent(alpha=0.0, eta0=0.05, power_t=0.5))
    a = np.column_stack([np.ones(len(y)), x])
    best = np.linalg.lstsq(a, y, rcond=None)[0]
    error = lambda c: ((a @ c - y) ** 2).mean()
    assert error(np.r_[b, w]) <= 1.01 * error(best)
    assert w[:2] == pytest.approx(best[1:3], rel=0.01)


def test_l1_makes_zeros_and_l2_shrinks(planted):
    _, _, rows = planted
    _, w = sgd.fit_descent(rows, sgd.Descent(alpha=0.2, l1_ratio=1.0, eta0=0.05, power_t=0.5))
    assert abs(w[2]) < 1e-2 and abs(w[0]) > 1
    _, v = sgd.fit_descent(rows, sgd.Descent(alpha=1.0, l1_ratio=0.0, eta0=0.05, power_t=0.5))
    assert v[0] == pytest.approx(1.5, abs=0.1)  # ridge with a penalty of 1 halves a standardised weight


@pytest.mark.parametrize("loss,epsilon", [("huber", 1.0), ("epsilon_insensitive", 0.1)])
def test_robust_losses_ignore_outliers(spark, planted, loss, epsilon):
    x, y, _ = planted
    wild = y.copy()
    wild[::25] += 500
    b, w = sgd.fit_descent(rows_of(spark, x, wild), sgd.Descent(loss, alpha=0.0, eta0=0.05, power_t=0.5, epsilon=epsilon, epochs=300))
    assert np.abs(b + x @ w - (3 * x[:, 0] - 0.2 * x[:, 1] + 7)).mean() < 1.0


def test_steps_follow_the_rows(spark, planted, monkeypatch):
    monkeypatch.setattr(sgd, "SHARD", 4000)  # three shards
    _, _, rows = planted
    p = sgd.Descent(epochs=4)
    one, two = sgd.fit_descent(rows, p), sgd.fit_descent(rows.repartition(7), p)
    assert one[0] == pytest.approx(two[0], rel=1e-9) and np.allclose(one[1], two[1], rtol=1e-9)
    same = rows_of(spark, np.ones((3000, 2)), np.ones(3000))
    sizes = [r["n"] for r in sgd.packed(same, 2, np.zeros(3), np.ones(3)).select("n").collect()]
    assert len(sizes) == 3 and max(sizes) < 1.2 * min(sizes)  # equal rows make equal shards


def test_steps_that_run_away_are_an_error(planted):
    with pytest.raises(ArithmeticError):
        sgd.fit_descent(planted[2], sgd.Descent(eta0=1e6, schedule="constant"))


@pytest.mark.parametrize("kernel", sorted(RF.KERNELS))
def test_kernel_features_give_the_kernel_of_the_landmarks(spark, kernel):
    x = np.abs(np.random.default_rng(1).normal(size=(6, 2))) + 0.1
    rows = rows_of(spark, x, x[:, 0])
    got = RF.fit_nystroem(rows, 6, kernel=kernel, gamma=0.4, scaled=False)(rows).orderBy("key").toPandas()
    z = np.stack(got["x"])
    want = RF.KERNELS[kernel](x, x, 0.4)
    value = np.linalg.eigvalsh(want)
    if value.min() > 1e-9:  # a positive kernel comes back whole
        assert np.allclose(z @ z.T, want, atol=1e-6)
    assert z.shape == (6, 6) and np.isfinite(z).all()


@pytest.mark.parametrize("name", ["boosting", "xgb", "ada_boost", "extra_trees", "sgd", "svr"])
def test_candidates_learn(spark, planted, name):
    x, y, rows = planted
    rng = np.random.default_rng(3)
    params = RF.SPACE[name](rng) | {"boosting": {"rate": 0.1, "rounds": 40, "loss": "huber", "max_depth": 4, "subsample": 1.0}, "xgb": {"rate": 0.1, "rounds": 40, "max_depth": 4, "subsample": 1.0}, "ada_boost": {"rounds": 20, "rate": 1.0},
                                    "extra_trees": {"trees": 15, "share": 1.0}, "sgd": {"loss": "squared", "eta0": 0.01, "alpha": 0.0, "power_t": 0.5, "intercept": True}, "svr": {"C": 10.0, "loss": "squared_epsilon_insensitive", "epsilon": 1e-3}}[name]
    some = rows.limit(900).persist()
    error = RF.candidate_errors([Candidate("standard", name, params)], some)[0]
    assert error < 0.4 * y.var()
    got = RF.fit_candidate(Candidate("none" if name != "sgd" else "standard", name, params), some)(some)
    assert got.count() == 900 and got.where("p IS NULL").count() == 0


def test_drawn_candidates_cover_the_space():
    drawn = RF.draw_candidates(300, seed=2)
    assert {c.name for c in drawn} == set(RF.SPACE)
    assert {c.params["loss"] for c in drawn if c.name == "boosting"} == {"squared", "absolute", "huber", "quantile"}
    assert all(c.params.get("rounds", 100) == c.params.get("trees", 100) == c.params.get("numTrees", 100) == 100 for c in drawn)
    assert len({c.prep.split(":")[1] for c in drawn if c.prep.startswith("nystroem")}) >= 6
