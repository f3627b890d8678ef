"""Rows, keys and values that broke operators once: each stays as a test."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import gram, mlp, models as MD, neighbors as NB, predict as P, refine as RF, shapley as SH
from colscope.operators.order import with_position
from colscope.operators.quantiles import exact_quantiles
from colscope.plans import complexity as CX, predictability as PP


@pytest.mark.parametrize("key", ["k % 20", "CASE WHEN k % 3 = 0 THEN NULL ELSE k END", "CAST(k % 7 AS STRING)", "k * 36028797018963968"])
def test_every_row_is_predicted_whatever_the_key(spark, key):
    df = spark.range(200).selectExpr("id AS k", "CAST(id AS DOUBLE) AS x", "CAST(id * id AS DOUBLE) AS y").selectExpr(f"{key} AS key", "x", "y")
    run = PP.scan_tuples(df, [(("x",), ("y",))], keys=["key"], with_dcor=False)
    assert run.predictions.count() == 200 and run.predictions.select("key").distinct().count() == 200


def test_scan_and_greedy_share_one_split(spark):
    df = spark.range(120).selectExpr("CAST(id % 5 AS INT) AS k", "CAST(id AS DOUBLE) AS x", "CAST(id % 11 AS DOUBLE) AS z", "CAST(id * 2 AS DOUBLE) AS y").repartition(7)
    run = PP.run_predictability(df, 2, 1, primkey_cols=["k"], targets=["y"], greedy=True, refined_n_best=0, with_dcor=False)
    sides = run.predictions.groupBy("key").agg(F.count_distinct("is_test").alias("n"))
    assert sides.count() == 120 and sides.filter("n > 1").isEmpty()


def test_positions_split_a_hot_key(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 10 < 8 THEN 'hot' ELSE CAST(id AS STRING) END AS k", "id AS v")
    got = with_position(df, ["k"])
    assert sorted(r[0] for r in got.select("position").collect()) == list(range(20_000))
    hot = got.filter("k = 'hot'").agg(F.min("position"), F.max("position")).first()
    assert hot[1] - hot[0] == 15_999
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, with_position(df.repartition(5), ["k"]).collect()))


def test_quantiles_with_infinities(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=30_000)
    v[:50], v[50:90], v[90:100] = np.inf, -np.inf, np.nan
    wide = r.uniform(-1.0, 1.0, 30_000) * 1.7e308
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, wide)], "a double, b double").repartition(4)
    probs = [0.0, 0.001, 0.1, 0.5, 0.9, 0.9999, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs)
    s = np.sort(v[~np.isnan(v)])
    for p, q in zip(probs, got["a"]):
        pos = p * (len(s) - 1)
        a, b = s[math.floor(pos)], s[math.ceil(pos)]
        assert q == a if a == b else math.isclose(q, a + (b - a) * (pos % 1), rel_tol=1e-12)
    w = np.sort(wide)
    assert got["b"][0] == w[0] and got["b"][-1] == w[-1] and math.isclose(got["b"][3], w[14_999] / 2 + w[15_000] / 2, rel_tol=1e-9)
    only = spark.createDataFrame([(float("inf"),), (float("-inf"),)], "a double")
    assert exact_quantiles(only, ["a"], [0.0, 1.0])["a"] == [float("-inf"), float("inf")]


def test_shapley_values_of_64_bit_keys(spark):
    rows = spark.range(6).selectExpr("(id - 3) * 1152921504606846976 AS key", "array(CAST(id AS DOUBLE), CAST(id * id AS DOUBLE), 1.0D) AS x")
    got = SH.shapley_values(rows, lambda r: r.withColumn("p", 2 * F.col("x")[0] - F.col("x")[1]), 3, [0.0, 0.0, 0.0]).collect()
    assert {(r.key, *np.round(r.phi, 9)) for r in got} == {((i - 3) * 1152921504606846976, 2.0 * i, -1.0 * i * i, 0.0) for i in range(6)}


def test_searches_use_the_given_score(spark):
    lim = MD.Limits(n_trials=3, rf_n_estimators=5, max_depth=4)
    rows = spark.range(90).selectExpr("id AS key", "id % 4 = 0 AS is_test", "CAST(id % 3 AS INT) AS fold", "CAST(id AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS y")
    rows = MD.feature_rows(rows, ["a"], "y")
    seen = []
    for sign in (1, -1):
        scorer = lambda y, p, sign=sign: sign * F.avg(F.abs(y - p))
        calls = MD.search_scorer(False, scorer)
        train = rows.where(~F.col("is_test"))
        params = [{"numTrees": 1, "maxDepth": 1}, {"numTrees": 5, "maxDepth": 8}]
        seen.append(MD._search_trees(MD.build_estimator("briskbagging", False, 1), train, params, False, calls, 2))
    assert seen[0] != seen[1]
    with pytest.raises(ValueError):
        MD.fit_base(rows, "slugrf", lim, scoring="no such score")
    with pytest.raises(ValueError):
        MD.search_scorer(True, "r2")


def test_only_numeric_failures_are_results(spark):
    def broken(kind):
        def fit(m, k):
            raise kind("no")
        return {"own": CX.Method(fit)}

    m = spark.createDataFrame([(1, [1.0, 2.0])], "key long, x array<double>")
    assert CX.measure("own", m, 1, {}, "s", 1, broken(ValueError))["status"].startswith("ValueError")
    with pytest.raises(RuntimeError):
        CX.measure("own", m, 1, {}, "s", 1, broken(RuntimeError))


def test_sums_of_columns_with_random_gaps_stay_small(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 30)) @ np.diag(np.arange(1, 31.0)) + 5
    x[r.random(x.shape) < 0.3] = np.nan
    cols = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([(k, *[None if np.isnan(v) else float(v) for v in row]) for k, row in enumerate(x)], "k long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    pairs = [(("c0", "c1"), ("c2",)), (("c29",), ("c3",)), (("c4", "c5", "c6"), ("c7",))]
    rows = P.split_rows(P.with_key(df, ["k"]), ["__key"]).select("__key", "is_test", "fold", *cols)
    fits = P.fit_baselines(rows, cols, pairs)
    side = {q["__key"]: q["is_test"] for q in rows.select("__key", "is_test").collect()}
    train = np.array([not side[k] for k in range(600)])
    for f, (ins, outs) in zip(fits, pairs):
        pick = [cols.index(c) for c in (*ins, *outs)]
        own = x[train & ~np.isnan(x[:, pick]).any(axis=1)][:, pick]
        want = np.linalg.lstsq(np.c_[np.ones(len(own)), own[:, :-1]], own[:, -1], rcond=None)[0]
        assert f.n_train == len(own) and np.allclose(f.linear[0], want, atol=1e-8)
    sums = gram.accumulate(rows, cols, {"raw": np.zeros(30)}, picks=[[0, 1, 2]])["raw"]["all"]
    assert set(sums) <= {-1, 0}


def test_networks_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mlp, "SHARD", 100)
    pts = spark.range(400).selectExpr("CAST(id % 2 AS INT) AS gid", "id AS key", "CAST(id % 3 AS INT) AS fold", "array(CAST(id AS DOUBLE)) AS x", "array(2.0D * id) AS y")
    got = []
    for parts in (2, 8):
        nets = [mlp.Net(g, g, 0, [1, 4, 1], 1e-4, np.array([200.0]), np.array([115.0]), np.array([400.0]), np.array([230.0]), mlp.start([1, 4, 1], 1)) for g in (0, 1)]
        got.append([n.w for n in mlp.train(pts.repartition(parts), nets, rounds=3)])
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(*got)) and not np.allclose(got[0][0], mlp.start([1, 4, 1], 1))


def test_equal_rows_make_equal_shards(spark, monkeypatch):
    monkeypatch.setattr(mlp, "SHARD", 100)
    monkeypatch.setattr(mlp, "WEIGHTS", 20)  # two networks a wave at most
    pts = spark.range(1000).selectExpr("0 AS gid", "id AS key", "CAST(id % 3 AS INT) AS fold", "array(IF(id < 900, 1D, CAST(id AS DOUBLE))) AS x", "array(1D) AS y")
    seen = []
    monkeypatch.setattr(mlp, "_rounds", lambda rows, nets, *rest: seen.append((rows.groupBy("shard").count().toPandas()["count"].tolist(), len(nets))))
    nets = [mlp.Net(i, 0, -1, [1, 4, 1], 1e-4, np.zeros(1), np.ones(1), np.zeros(1), np.ones(1), mlp.start([1, 4, 1], 1)) for i in range(5)]
    mlp.train(pts, nets)
    assert [n for _, n in seen] == [2, 2, 1] and len(seen[0][0]) == 10 and max(seen[0][0]) < 150


def test_predictions_of_networks_are_not_joined(spark, monkeypatch):
    """Rows times networks go straight into the scores, from as many tasks as there are rows for; networks keep their setting and fold."""
    plans, parts, kept = {}, {}, P.cut
    monkeypatch.setattr(P, "cut", lambda df, label="cut": (plans.setdefault(label, df._jdf.queryExecution().toString()), parts.setdefault(label, df.rdd.getNumPartitions()), kept(df, label))[2])
    monkeypatch.setattr(P, "PREDICTED", 60)
    df = spark.range(300).selectExpr("id AS k", "CAST(id AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS z", "2.0D * id AS y").coalesce(1)
    run = PP.scan_tuples(df, [(("x",), ("y",)), (("z",), ("y",))], keys=["k"], method="MLP", hidden_layers=[(3,), (2, 2)], alphas=[1e-3, 1e-5], rounds=1, with_dcor=False)
    assert "Join" not in plans["cv"] and parts["points"] == 10
    got = [(r["tuple_id"], r["params"]["hidden_layer_sizes"], r["params"]["alpha"], r["params"]["scaler"], r["fold"]) for r in run.cv.collect()]
    assert sorted(got) == sorted((t, h, a, s, f) for t in (0, 1) for h in ("3", "2-2") for a in ("0.001", "1e-05") for s in ("true", "false") for f in range(3))


def test_rows_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    """The fits of a refinement read a table in as many tasks as there are rows for, the same rows as before; small tables stay as they are."""
    tasks, plain = [], RF.candidate_errors
    monkeypatch.setattr(RF, "candidate_errors", lambda c, train, **o: (tasks.append((train.rdd.getNumPartitions(), train.count())), plain(c, train, **o))[1])
    df = spark.range(400).selectExpr("id AS k", "CAST(id AS DOUBLE) AS x", "2.0D * id AS y").coalesce(1)
    space = {"random_forest": lambda r: {"numTrees": 3, "maxDepth": 8}}
    for per in (RF.DEALT, 100):
        monkeypatch.setattr(RF, "DEALT", per)
        got = RF.refine_tuples(df, [(0, ("x",), ("y",))], ["k"], n_trials=1, space=space, preparations=["none"])
        assert {r["metric"]: r["value"] for r in got.metrics.collect()}["r2"] > 0.9
    assert tasks[0][0] == 1 and tasks[1][0] > 1 and tasks[0][1] == tasks[1][1]


def test_neighbour_model_takes_one_search(spark, monkeypatch):
    """One search gives the settings' means and both scores, those of a search per step, rows near the border of a cell included."""
    monkeypatch.setattr(NB, "CELL", 64)
    monkeypatch.setattr(NB, "ENTRIES", 500)
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(900, 3)), 1)
    data = [(i, bool(i % 3 == 0), int(r.integers(3)), float(v.sum() + r.normal()), v.tolist()) for i, v in enumerate(x)]
    rows = spark.createDataFrame(data, "key long, is_test boolean, fold int, label double, x array<double>").coalesce(2)
    lim, searches, plain = MD.Limits(n_trials=6, n_neighbors=9), [], MD.nearest
    monkeypatch.setattr(MD, "nearest", lambda *a, **o: (searches.append(1), plain(*a, **o))[1])
    got = MD.fit_base(rows, "briskknn", lim)
    assert len(searches) == 1 and {p["weights"] for p in MD.sample_params("briskknn", lim)} == {"uniform", "distance"}
    train = rows.where("NOT is_test")
    assert got.params == MD._search_knn(train, MD.sample_params("briskknn", lim), False, MD.search_scorer(False, "r2"))
    assert got.scores == pytest.approx(MD.train_test_scores(got.predict(rows), MD.default_scorer(False)), rel=1e-12)


@pytest.mark.parametrize("ties", [False, True])
def test_narrow_neighbours_sort_what_lies_within_reach(monkeypatch, ties):
    """The lists of all distances, though only rows within a query's own bound are sorted."""
    r = np.random.default_rng(6)
    base, sorted_ = r.normal(size=(1500, 3)), []
    base = np.round(base * 3) if ties else base
    queries, key = np.vstack([base[:200], r.normal(size=(100, 3))]), r.permutation(1500)
    plain = NB._first
    monkeypatch.setattr(NB, "_first", lambda dist, *a: (sorted_.append(dist.size), plain(dist, *a))[1])
    row, dist, at, _ = NB.local_nearest(queries, base, key, np.zeros(1500, int), 7)
    assert not sorted_
    every = NB.distances(queries, base)
    for i in range(len(queries)):
        want = sorted(range(1500), key=lambda j: (every[i, j], key[j]))[:7]
        assert at[row == i].tolist() == want and np.array_equal(dist[row == i], every[i, want])
