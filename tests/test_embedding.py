import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import colscope
from colscope.operators import linear_dim as L, nonlinear_dim as N, quality as Q
from colscope.operators.matrix import matrix_moments, standardize_matrix
from colscope.plans import complexity as CX
from colscope.session import cut
from colscope.streaming.incremental import merged_components, save_batch


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 3)) @ rng.normal(size=(3, 6)) + 0.01 * rng.normal(size=(150, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key bigint, x array<double>")
    return cut(df), x


def test_components_equal_numpy(data):
    m, x = data
    p = L.pca(m, 2)
    val, vec = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(p.values, val[::-1][:2]) and np.allclose(np.abs(p.weights), np.abs(vec[:, ::-1][:, :2]))
    assert np.allclose(L.truncated_svd(m, 2).values, np.linalg.svd(x)[1][:2])
    y = np.array([r["y"] for r in p.transform(m).orderBy("key").collect()])
    assert np.allclose(y, (x - x.mean(0)) @ p.weights)


def test_batches_give_the_same_components(data):
    m, _ = data
    whole, parts = L.pca(m, 3), L.incremental_pca((m.where(F.col("key") % 3 == i) for i in range(3)), 3)
    assert np.allclose(whole.values, parts.values) and np.allclose(whole.weights, parts.weights)


def test_standardised_matrix(data):
    m, _ = data
    s = standardize_matrix(m, matrix_moments(m, 6)[0])
    mo = matrix_moments(s, 6)[0]
    assert np.allclose(mo.mean, 0) and np.allclose(np.diag(mo.scatter) / mo.n, 1)


def test_robust_components_resist_outliers(spark, data):
    m, x = data
    bad = m.unionByName(spark.createDataFrame([(1000 + i, [1e4 * (j == 5) for j in range(6)]) for i in range(1)], "key bigint, x array<double>").select("key", F.col("x").cast("array<double>").alias("x")))
    plain, robust = L.pca(bad, 1).weights[:, 0], L.robust_pca(bad, 1, 9).weights[:, 0]
    true = L.pca(m, 1).weights[:, 0]
    assert abs(robust @ true) > abs(plain @ true)


def test_sparse_loadings_have_zeros(spark):
    rng = np.random.default_rng(2)
    x = np.zeros((200, 6))
    x[:, :3] = rng.normal(size=(200, 1)) * 3
    x += 0.1 * rng.normal(size=x.shape)
    m = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key bigint, x array<double>")
    w = L.sparse_pca(m, 1, alpha=0.5).weights[:, 0]
    assert np.all(w[3:] == 0) and np.all(w[:3] != 0)


def test_quality_of_the_identity_is_one(data):
    m, _ = data
    assert Q.embedding_quality(m.withColumn("y", F.col("x"))) == {"rel_err": 1.0, "r2": 1.0}
    q = Q.coranking(m.withColumn("y", F.col("x")))
    assert q.where("rank_high <> rank_low").count() == 0 and q.agg(F.sum("n")).first()[0] == 150 * 149


def test_quality_and_coranking_use_all_rows(spark):
    """3,200 rows are more than a sample of about 2,000 would hold."""
    m = spark.range(3200).select(F.col("id").alias("key"), F.array(*[F.rand(s) for s in range(3)]).alias("x")).withColumn("y", F.slice("x", 1, 1))
    assert Q.quality_table(m).first()["n"] == 3200
    assert Q.coranking(m).agg(F.sum("n")).first()[0] == 3200 * 3199


@pytest.mark.parametrize("held", [Q.HELD, 1 << 12])
def test_coranking_and_quality_equal_brute_force(spark, monkeypatch, held):
    """Ties go by key; with small bounds a task keeps the table in a file and counts many strips."""
    monkeypatch.setattr(Q, "HELD", held)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 1)
    m = spark.createDataFrame([(int(i), x[i].tolist(), x[i, :2].tolist()) for i in rng.permutation(300)], "key bigint, x array<double>, y array<double>")
    high, low = Q.rank_matrix(x, slice(None)), Q.rank_matrix(np.ascontiguousarray(x[:, :2]), slice(None))
    cell, k = np.unique((high * 300 + low)[(high > 0) & (low > 0)], return_counts=True)
    got = Q.coranking(m).toPandas().sort_values(["rank_high", "rank_low"])
    assert (got["rank_high"] * 300 + got["rank_low"]).tolist() == cell.tolist() and got["n"].tolist() == k.tolist()
    q = Q.quality_table(m).first()
    assert q["n"] == 300 and np.allclose([q["rel_err"], q["r2"]], [1 - np.abs(high - low).mean() / 149.5, 1 - ((high - low) ** 2).sum() / (300**2 * (300**2 - 1) / 12)])


def test_quality_of_few_rows(spark):
    for n in (0, 1):
        m = spark.range(n).select(F.col("id").alias("key"), F.array(F.lit(1.0)).alias("x"), F.array(F.lit(1.0)).alias("y"))
        assert tuple(Q.quality_table(m).first()) == (n, None, None) and Q.coranking(m).count() == 0


def test_embeddings_keep_low_rank_structure(data):
    m, _ = data
    for fn in (lambda: L.probabilistic_pca(m, 3).transform(m), lambda: N.curvilinear(m, 3, max_iter=2), lambda: N.proximity(m, 3, cycles=5, updates=20),
               lambda: L.adaptive_reduction(m, 3, 2).transform(m)):
        assert Q.embedding_quality(fn())["rel_err"] > 0.65


def _plain_adaptive(m, k, rounds):
    """The method as it reads: cluster the projections, then take the main directions between the clusters' means."""
    mo = matrix_moments(m, len(m.first()["x"]))[0]
    p = L.pca(m, k)
    for _ in range(rounds):
        proj = p.transform(m).withColumn("v", array_to_vector("y"))
        got = KMeans(k=k + 1, featuresCol="v", predictionCol="c", seed=1, maxIter=20).fit(proj).transform(proj).select("x", "c").collect()
        scatter = 0
        for c in {r["c"] for r in got}:
            x = np.array([r["x"] for r in got if r["c"] == c])
            scatter = scatter + len(x) * np.outer(x.mean(0) - mo.mean, x.mean(0) - mo.mean)
        val, vec = L._eigen(scatter)
        gap = np.linalg.norm(vec[:, :k] @ vec[:, :k].T - p.weights @ p.weights.T)
        p = L.Projection(mo.mean, vec[:, :k], val[:k])
        if gap < 1e-3:
            break
    return p


def test_adaptive_reduction_equals_the_plain_method(data):
    m = cut(data[0].coalesce(1))  # starting centres are drawn by task
    for k, rounds in ((2, 3), (1, 1), (3, 0)):
        got, want = L.adaptive_reduction(m, k, rounds), _plain_adaptive(m, k, rounds)
        assert np.allclose(got.weights, want.weights, atol=1e-9) and np.allclose(got.values, want.values) and np.allclose(got.mean, want.mean)


def test_adaptive_reduction_clusters_stored_projections(data, monkeypatch):
    """Clustering reads its rows in many jobs; unless they are stored, each of some maps the table in Python again."""
    plans, fit = [], L.KMeans.fit
    monkeypatch.setattr(L.KMeans, "fit", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), fit(self, df))[1])
    L.adaptive_reduction(data[0], 2, 2)
    assert plans and all("InMemoryTableScan" in p for p in plans)


def test_adaptive_reduction_spreads_a_large_file(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)) + 20 * np.eye(4)[rng.integers(0, 3, 400)]
    m = cut(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key bigint, x array<double>").coalesce(1))
    tasks, fit = [], L.KMeans.fit
    monkeypatch.setattr(L.KMeans, "fit", lambda self, df: (tasks.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    one = L.adaptive_reduction(m, 2, 3)
    monkeypatch.setattr(L, "TASK_ROWS", 100)
    more = L.adaptive_reduction(m, 2, 3)
    assert tasks[0] == 1 and tasks[-1] > 1
    assert np.allclose(one.weights @ one.weights.T, more.weights @ more.weights.T, atol=1e-6)  # three clear clusters, whatever they start from


def test_sammon_stress_falls(data):
    m, x = data
    d = lambda v: np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    start = np.array([r["y"] for r in L.pca(m, 2).transform(m).orderBy("key").collect()])
    end_rows = N.sammon(m, 2, max_iter=3)
    end = np.array([r["y"] for r in end_rows.orderBy("key").collect()])
    hi = d(x) + np.eye(len(x))
    e = lambda y: (((d(x) - d(y)) ** 2) / hi).sum()
    assert e(end) < e(start)
    assert N.stress(end_rows, 150, sammon=True) == pytest.approx(e(end))


def test_pivot_batches_do_not_change_the_result(data):
    m, _ = data
    a = {r["key"]: r["y"] for r in N.curvilinear(m, 2, max_iter=1).collect()}
    b = {r["key"]: r["y"] for r in N.curvilinear(m.repartition(5), 2, max_iter=1).collect()}
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_task_finds_the_rank(spark, data):
    m, x = data
    dim, best, summary = colscope.complexity(m, keys=["key"], matrix_col="x", cutoff_loss=0.97, functions=["py_pca", "r_mds"], budget=lambda p: (1, 0))
    assert dim == 3 and {r["fun_id"] for r in best} == {"py_pca", "r_mds"} and best[0]["data_lowdim"].count() == 150
    assert summary.where("status <> 'ok'").count() == 0
    wide = m.select("key", *[F.col("x")[i].alias(f"c{i}") for i in range(6)], F.lit("t").alias("text"))
    assert colscope.complexity(wide, keys=["key"], cutoff_loss=0.9, functions=["py_pca"])[0] <= 3


def test_stored_batches_stay_few_and_complete(spark, data, tmp_path):
    m, _ = data
    path = str(tmp_path / "moments")
    for i in range(11):
        save_batch(m.where(F.col("key") % 11 == i) if i != 4 else m.limit(0), i, path, 3)
    save_batch(m.where("key % 11 = 10"), 10, path, 3)  # a stream repeats its last batch
    for repeat in range(2):
        save_batch(m.where("key % 11 = 4"), 11, path, 3)  # and one that makes a total
        got, want = merged_components(spark, path, 3), L.pca(m, 3)
        assert np.allclose(got.values, want.values) and np.allclose(np.abs(got.weights), np.abs(want.weights))
    stored = [len([p for p in (tmp_path / "moments" / t).iterdir() if p.name.startswith("number=")]) for t in ("batches", "totals")]
    assert stored == [3, 2]


def test_quality_says_how_many_rows_it_used(spark, data):
    m, x = data
    dim, _, summary = CX.complexity(m, keys=["key"], matrix_col="x", cutoff_loss=0.9, functions=["py_pca"], budget=lambda p: (1, 0), around=40)
    used = {r["rows_quality"] for r in summary.where("status = 'ok'").collect()}
    assert used and all(0 < u <= len(x) / 2 for u in used)
    full = CX.complexity(m, keys=["key"], matrix_col="x", cutoff_loss=0.9, functions=["py_pca"], budget=lambda p: (1, 0))[2]
    assert max(r["rows_quality"] for r in full.collect()) == len(x)


def test_sizes_of_a_sammon_step_share_a_pass(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(120, 32))
    m = cut(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key bigint, x array<double>"))
    passes, plain = [], N.pair_sums
    monkeypatch.setattr(N, "pair_sums", lambda *a, **b: (passes.append(a[2]), plain(*a, **b))[1])
    end = N.sammon(m, 2, max_iter=2)
    assert len(passes) <= 1 + 2 * 3 and max(map(len, passes)) >= N.HALVES
    assert N.stress(end, 120, sammon=True) < N.stress(N._start(m, 2), 120, sammon=True)


def test_only_rows_in_reach_are_measured(monkeypatch):
    """Rows beyond the reach of a pivot neither move nor have their original distance taken."""
    class State:
        schema = None

        def mapInPandas(self, run, schema):
            return lambda frame: next(run(iter([frame])))

    monkeypatch.setattr(N, "cut", lambda df, label: df)
    measured = []

    def rule(i, y, at, high, low):
        measured.append(len(high))
        return (0.5 * (low < 1.0) * (high - low) / low)[:, None] * (y - at)

    y = np.array([[0.0, 0.0], [0.5, 0.0], [3.0, 0.0], [0.0, 4.0]])
    rows = pd.DataFrame({"key": range(4), "x": list(y * 2), "y": list(y)})
    pivot = [{"key": 0, "x": [0.0, 0.0], "y": [0.0, 0.0]}]
    got = np.array(N._move(State(), pivot, rule, 1.0)(rows)["y"].tolist())
    assert measured == [1] and np.allclose(got, [[0, 0], [0.75, 0], [3, 0], [0, 4]])
