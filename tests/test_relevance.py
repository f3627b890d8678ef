import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import colscope
from colscope.operators import knockoff as KO, models as MD, refine as RF, shapley as SH
from colscope.plans.relevance import check_options


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n, d = 800, 12
    x = rng.normal(size=(n, d))
    x[:, 1] = 0.6 * x[:, 0] + 0.8 * x[:, 1]
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(d)])
    pdf["y"] = x[:, :6] @ np.array([3, -3, 2, 2, -2, 3.0]) + rng.normal(size=n)
    pdf["key"] = np.arange(n)
    return spark.createDataFrame(pdf)


FEATURES = [f"f{i}" for i in range(12)]


def test_knockoffs_have_the_joint_covariance(spark, planted):
    s = KO.fit_sampler(planted, FEATURES)
    z = np.array([r["x"] for r in KO.knockoff_rows(planted, FEATURES, s, 1).collect()])
    c = np.cov(z.T)
    orig, fake, cross = c[:12, :12], c[12:, 12:], c[:12, 12:]
    assert np.abs(orig - fake).max() < 0.2
    assert np.abs(cross - (orig - np.diag(s.s))).max() < 0.2


def test_knockoffs_find_planted_features(spark, planted):
    runs, scores = KO.simulate_knockoffs(planted, FEATURES, "y", 0.2, ["lasso", "ridge"], 3, zero_selected=False)
    mean = {r["feature"]: r["s"] for r in runs.groupBy("feature").agg(F.avg("selected").alias("s")).collect()}
    assert min(mean[f"f{i}"] for i in range(6)) > 0.9
    assert np.mean([mean[f"f{i}"] for i in range(6, 12)]) < 0.3
    assert {r["feature"] for r in scores.orderBy(F.desc("score")).limit(6).collect()} == set(FEATURES[:6])


def test_null_target_selects_little(spark, planted):
    df = planted.withColumn("y", F.sin(F.col("key") * 12.9898) * 43758.5 % 1)
    runs, _ = KO.simulate_knockoffs(df, FEATURES, "y", 0.2, ["lasso"], 4)
    assert runs.agg(F.avg("selected")).first()[0] < 0.25


def test_penalised_fit_without_penalty_is_least_squares():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, 2.0, 0.0] + rng.normal(size=300) * 0.01
    a = np.column_stack([np.ones(300), x, y])
    parts = {f: a[f::5].T @ a[f::5] for f in range(5)}
    assert np.allclose(KO.penalised_fit(parts, "ridge"), [1, 2, 0], atol=0.02)
    assert np.allclose(KO.penalised_fit(parts, "lasso"), [1, 2, 0], atol=0.02)


def test_shapley_values_add_up(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "key bigint, x array<double>")
    f = lambda r: r.withColumn("p", F.col("x")[0] * F.col("x")[1] + 2 * F.col("x")[2] - F.col("x")[3] * F.col("x")[3])
    got = SH.shapley_values(rows, f, 4, [0.5, 0.0, 1.0, 0.0]).join(rows, "key").collect()
    for r in got:
        x = r["x"]
        assert sum(r["phi"]) == pytest.approx(x[0] * x[1] + 2 * x[2] - x[3] ** 2 - 2.0)
        assert r["phi"][2] == pytest.approx(2 * (x[2] - 1))
    back = SH.background_shapley(rows, f, 4, share=1.0, draws=3).collect()
    assert len(back) == 30


def test_gradient_methods_on_a_line(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "key bigint, x array<double>")
    w = np.array([2.0, -3.0])
    grad = lambda x: np.repeat(w[None], len(x), axis=0)
    for r in SH.integrated_gradients(rows, grad).collect():
        assert r["phi"] == pytest.approx([2.0 * r["key"], -3.0])
    got = SH.gradient_shap(rows, grad, noise=0.0).agg(F.sum(F.col("phi")[1])).first()[0]
    assert got == pytest.approx(0.0)


def test_linear_svr_finds_the_slope(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [1, 10]
    rows = spark.createDataFrame([(a.tolist(), float(3 * a[0] + 0.5 * a[1] + 1)) for a in x], "x array<double>, label double")
    b, w = RF.fit_linear_svr(rows, 2, C=10.0, epsilon=0.001)
    assert np.allclose(w, [3, 0.5], atol=0.2) and abs(b - 1) < 0.4


def test_preparations_keep_rows(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(50)], "key bigint, x array<double>").withColumn("features", array_to_vector("x"))
    for name in RF.PREPARATIONS:
        got = RF.fit_preparation(name, rows)(rows)
        assert got.columns == rows.columns and got.count() == 50


def test_options():
    assert check_options({"list_base_models": ["slugrf"]})["base_models"] == ["slugrf"]
    for bad in ({"fdr": 2}, {"pred_class": "x"}, {"base_models": ["y"]}, {"n_trials": 0}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            check_options(bad)


def test_sampled_settings_are_seeded_and_in_range():
    lim = MD.Limits(n_trials=20, n_neighbors=9)
    for name in MD.MODEL_NAMES:
        assert MD.sample_params(name, lim) == MD.sample_params(name, lim)
    assert all(5 <= p["k"] <= 9 for p in MD.sample_params("briskknn", lim))


def test_task_ranks_planted_inputs_first(spark, planted):
    out = colscope.relevance(planted.select("key", "f5", "f2", "f9", "y"), ["f5", "f2", "f9"], "y", {
        "keys": ["key"], "base_models": ["briskbagging", "briskknn"], "n_trials": 1, "bagging_estimators": 12, "n_neighbors": 8,
        "ensemble_n_trials": 1, "ensemble_bagging_estimators": 12, "knockoff_runs": 2, "fstats": ["ridge"]})
    assert out["xai_model"].orderBy("score").first()["feature"] == "f9"
    assert out["xai_non_model"].orderBy("w").first()["feature"] == "f9"
    assert set(out["base_model_scores"]) == {"briskbagging", "briskknn"} and out["score"][1] > 0


def test_forest_makes_every_knockoff_once(spark, tmp_path):
    from colscope.operators import knockoff as KO
    log = str(tmp_path / "made")

    class Counted(KO.Sampler):
        def __call__(self, x, key, run):
            with open(log, "a") as f:
                f.write(f"{len(x)}\n")
            return super().__call__(x, key, run)

    x = np.random.default_rng(5).normal(size=(400, 2))
    df = spark.createDataFrame([(i, *map(float, r), float(r[0])) for i, r in enumerate(x)], "key bigint, a double, b double, y double").repartition(2)
    got = {r["feature"]: r["w"] for r in KO.forest_statistics(df, ["a", "b"], "y", Counted(np.zeros(2), np.eye(2)), 1, trees=5, depth=3).collect()}
    assert got["a"] > abs(got["b"])
    assert sum(map(int, open(log).read().split())) == 400


def test_background_rows_are_not_broadcast(spark):
    """The sample grows with the rows; only its stored size, compressed, is small."""
    rows = spark.range(2000).select(F.col("id").alias("key"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    drawn = SH.with_background(rows, 0.3, 2)
    assert "Broadcast" not in drawn._jdf.queryExecution().executedPlan().toString()
    assert drawn.count() == 4000
