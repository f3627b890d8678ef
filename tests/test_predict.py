import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import colscope
from colscope.operators import gram, neighbors as NB, predict as P
from colscope.operators.dcor import distance_correlation, distance_correlation_blocks
from colscope.plans import predictability as PP


def brute_dcor(x, y):
    a, b = (np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)) for v in (x.reshape(len(x), -1), y.reshape(len(y), -1)))
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    return np.sqrt(max((a * b).mean(), 0) / np.sqrt((a * a).mean() * (b * b).mean()))


def test_distance_correlation_of_groups_and_strips(spark):
    rng = np.random.default_rng(0)
    parts, want = [], {}
    for g, n in enumerate((50, 900)):
        x = np.round(rng.normal(size=n), 1)
        y = np.round(x**2 + rng.normal(size=n), 1)
        x[: n // 3] = 0.5  # a third of the rows share a value
        y[n // 2: n // 2 + n // 3] = -1.0
        parts.append(pd.DataFrame({"gid": g, "key": np.arange(n), "x": x, "y": y}))
        want[g] = brute_dcor(x, y)
    df = spark.createDataFrame(pd.concat(parts)).withColumn("gid", F.col("gid").cast("int"))
    for rows in (10_000, 60):
        got = {r["gid"]: r["dcor"] for r in distance_correlation(df, strip_rows=rows).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    blocks = distance_correlation_blocks(df.select("gid", "key", F.array("x").alias("x"), F.array("y").alias("y")), 100)
    assert {r["gid"]: r["dcor"] for r in blocks.collect()} == pytest.approx(want, abs=1e-9)


def test_distance_correlation_of_several_outputs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    y = x[:, ::-1] ** 2
    rows = [(0, i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    got = distance_correlation_blocks(spark.createDataFrame(rows, "gid int, key bigint, x array<double>, y array<double>"), 30).first()["dcor"]
    assert got == pytest.approx(brute_dcor(x, y), abs=1e-10)


@pytest.mark.parametrize("block, d, p", [(4096, 2, 2), (48, 1, 2), (48, 2, 2), (48, 3, 1)])
def test_neighbours_equal_brute_force(spark, monkeypatch, block, d, p):
    monkeypatch.setattr(NB, "BLOCK", block)
    monkeypatch.setattr(NB, "QUERY_BLOCK", block)
    monkeypatch.setattr(NB, "CELL", block)
    rng = np.random.default_rng(d)
    x, q = np.round(rng.normal(size=(1500, d)), 1), np.round(rng.normal(size=(200, d)), 1)
    x[:500] = 0.3  # a third of the rows are copies
    q[:60] = 0.3
    part = np.arange(1500) % 3
    base = spark.createDataFrame([(0, i, x[i].tolist(), int(part[i]), [float(i)]) for i in range(1500)], "gid int, key bigint, x array<double>, part int, y array<double>")
    query = spark.createDataFrame([(0, i, q[i].tolist(), 1.0) for i in range(200)], "gid int, key bigint, x array<double>, c double")
    near = NB.nearest(query, base, 5, carry=("c",), p=p)
    got = {r["key"]: r["k"] for r in near.select("key", F.expr(f"transform({NB.best_of('nn', 5, 1)}, n -> n.key)").alias("k")).collect()}
    dist, ok = NB.distances(q, x, p), np.where(part != 1)[0]
    for i in range(200):
        assert got[i] == list(ok[np.lexsort((ok, dist[i, ok]))][:5])


def test_votes_and_weights(spark):
    df = spark.sql("SELECT array(named_struct('d', 0D, 'key', 1L, 'part', 0, 'y', array(2D)), named_struct('d', 0D, 'key', 2L, 'part', 0, 'y', array(4D)), "
                   "named_struct('d', 3D, 'key', 3L, 'part', 0, 'y', array(4D)), named_struct('d', 4D, 'key', 4L, 'part', 0, 'y', array(2D))) AS nn")
    r = df.select(NB.vote_of("nn").alias("v"), NB.mean_of("nn", 0, "distance").alias("w"), NB.mean_of("nn").alias("m")).first()
    assert (r["v"], r["w"], r["m"]) == (2.0, 3.0, 3.0)


def test_shared_moments_equal_direct_fits(spark):
    rng = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame(rng.lognormal(size=(n, 3)), columns=list("abc"))
    pdf["y"] = pdf["a"] * 2 + rng.normal(size=n) * 0.1 + 3
    pdf.loc[::7, "a"] = None
    pdf.loc[::5, "b"] = None
    pdf["k"] = np.arange(n)
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "ab"})
    rows = P.split_rows(P.with_key(df, ["k"]), ["__key"]).select("__key", "is_test", "fold", *"abcy")
    pairs = [(("a", "b"), ("y",)), (("b",), ("y",)), (("c", "a"), ("y",))]
    fits = P.fit_baselines(rows, list("abcy"), pairs)
    side = {r["__key"]: r["is_test"] for r in rows.collect()}
    train = pdf[~pdf["k"].map(side)]
    for fit, (ins, _) in zip(fits, pairs):
        t = train.dropna(subset=list(ins))
        want = np.linalg.lstsq(np.column_stack([np.ones(len(t)), t[list(ins)]]), t["y"], rcond=None)[0]
        assert fit.n_train == len(t)
        assert np.allclose(fit.linear[0], want)
        logs = np.linalg.lstsq(np.column_stack([np.ones(len(t)), np.log(t[list(ins)])]), np.log(t["y"]), rcond=None)[0]
        assert np.allclose(fit.power[0], logs)


def test_moments_keep_their_digits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2)) + 1e8
    mo = gram.table_moments(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"])
    assert np.allclose(mo.cov, np.cov(x.T), rtol=1e-6)


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(4)
    n = 600
    x = np.linspace(0, 20, n)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x, "noise": rng.normal(size=n), "sinx": np.sin(x), "sin1": np.sin(x) + 2}))


def test_planted_wave_is_found(spark, waves):
    out = colscope.run_predictability(waves, 1, 1, primkey_cols=["id"], targets=["sinx", "sin1"], refined_n_best=0)
    m = {(tuple(r["inputs"]), r["outputs"][0]): r for r in out.wide().collect()}
    assert m[("x",), "sinx"]["kNN r2"] > 0.98 and m[("noise",), "sinx"]["kNN r2"] < 0.1
    assert m[("x",), "sinx"]["linear r2"] < 0.3 and m[("x",), "sinx"]["pow. law r2"] is None
    assert m[("x",), "sinx"]["kNN dcor"] > 0.98
    best = {tuple(r["outputs"]): tuple(r["inputs"]) for r in PP.best_per_target(out.metrics, out.tuples).collect()}
    assert best == {("sinx",): ("x",), ("sin1",): ("x",)}
    assert colscope.tuple_selection(out.metrics, 2).count() == 2
    rows, hist = colscope.predictability_plot(out, m[("x",), "sin1"]["tuple_id"])
    assert rows.where("method = 'main'").agg(F.count("*")).first()[0] == hist.where("method = 'main'").agg(F.sum("n")).first()[0]


def test_greedy_keeps_the_best_first(spark, waves):
    out = PP.greedy_scan(waves, ["x", "noise"], 2, [("sinx",)], keys=["id"], scaling="test", with_dcor=False)
    tuples = {r["tuple_id"]: tuple(r["inputs"]) for r in out.tuples.collect()}
    assert tuples == {0: ("x",), 1: ("noise",), 2: ("x", "noise")}


def test_scaled_search_uses_fold_statistics(spark):
    rng = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n) * 1000})
    pdf["y"] = pdf["a"] * 5
    run = PP.scan_tuples(spark.createDataFrame(pdf), [(("a", "b"), ("y",))], keys=["id"], with_dcor=False)
    side = {r["key"]: (r["is_test"], r["fold"]) for r in run.predictions.collect()}
    is_test, fold = (np.array([side[i][j] for i in range(n)]) for j in (0, 1))
    x, y = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy()
    got = {(r["params"]["n_neighbors"], r["params"]["scaler"], r["fold"]): r["test_score"] for r in run.cv.collect()}
    for f in range(3):
        tr, va = ~is_test & (fold != f), ~is_test & (fold == f)
        for scaled in ("true", "false"):
            m, s = (x[tr].mean(0), x[tr].std(0)) if scaled == "true" else (0, 1)
            d = NB.distances((x[va] - m) / s, (x[tr] - m) / s)
            p = y[tr][np.argsort(d, axis=1, kind="stable")[:, :3]].mean(1)
            assert got["3", scaled, f] == pytest.approx(1 - ((y[va] - p) ** 2).sum() / ((y[va] - y[va].mean()) ** 2).sum())
    assert run.wide().first()["kNN r2"] > 0.9


def test_mlp_learns_a_curve(spark, waves):
    run = PP.scan_tuples(waves.where("x < 6"), [(("x",), ("sinx",))], keys=["id"], method="MLP", hidden_layers=[(20,)], alphas=[1e-4], scaling="yes", with_dcor=False)
    assert run.wide().first()["MLP r2"] > 0.9


def test_refinement_beats_the_line(spark, waves):
    run = PP.scan_tuples(waves, [(("x",), ("sinx",))], keys=["id"], with_dcor=False)
    got = PP.refine_predictability(waves, run, 1, ["id"], n_trials=2, space={"decision_tree": lambda r: {"maxDepth": 8, "minInstancesPerNode": 2}, "ridge": lambda r: {"regParam": 0.1}}, preparations=["none"])
    m = {r["metric"]: r["value"] for r in got.metrics.collect()}
    assert m["r2"] > 0.9 and got.trials.count() == 2
    assert PP.compare_refined(run.metrics, got.metrics).where("metric = 'r2'").first()["refined"] == pytest.approx(m["r2"])


def test_wide_neighbours_come_from_products_of_matrices(monkeypatch):
    """Few distances of wide rows are taken one by one, and the lists are those of all of them, ties and equal rows included."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 16)) + 50
    base[200:240], base[300:340] = base[0], np.round(base[300:340])
    queries = np.vstack([rng.normal(size=(300, 16)) + 50, base[190:250], np.round(base[300:340])])
    key, part = rng.permutation(1500), np.arange(1500) % 2
    taken, plain = [], NB.distances
    monkeypatch.setattr(NB, "distances", lambda a, b, p=2: (taken.append(len(a) * len(b)), plain(a, b, p))[1])
    row, dist, at, _ = NB.local_nearest(queries, base, key, part, 5)
    assert sum(taken) < len(queries) * len(base) / 4
    every = plain(queries, base)
    for i in range(len(queries)):
        want = np.concatenate([sorted(np.flatnonzero(part == p), key=lambda j: (every[i, j], key[j]))[:5] for p in (0, 1)])
        want = sorted(want, key=lambda j: (every[i, j], key[j]))
        assert list(at[row == i]) == want and list(dist[row == i]) == list(every[i, want])
