"""Own tree ensembles against numpy versions and planted truths."""

import numpy as np
import pytest

from colscope.operators import boosting as B, models as MD, trees as T


def table(spark, x, y):
    rows = [(i, float(v), i % 3, list(map(float, a))) for i, (a, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key long, label double, fold int, x array<double>").repartition(3)


@pytest.fixture(scope="module")
def grid(spark):
    draw = np.random.default_rng(0)
    x = draw.integers(0, 9, (240, 3))
    y = np.round(3 * (x[:, 0] > 4) + x[:, 1] * 0.5 + draw.normal(size=240), 2)
    return x.astype(float), y, table(spark, x, y).persist()


def brute_tree(x, g, h, spec, depth=0):
    """Nested (value | column, threshold, left, right) by trying every value of every column."""
    value = T.leaf_value(g.sum(), h.sum(), spec)
    worth = lambda a, b: T.shrunk(a, spec.l1) ** 2 / (b + spec.l2)
    best = None
    if depth < spec.max_depth:
        for j in range(x.shape[1]):
            for v in np.unique(x[:, j])[:-1]:
                go = x[:, j] <= v
                if min(go.sum(), (~go).sum()) < spec.min_rows or min(h[go].sum(), h[~go].sum()) < spec.min_weight:
                    continue
                gain = (worth(g[go].sum(), h[go].sum()) + worth(g[~go].sum(), h[~go].sum()) - worth(g.sum(), h.sum())) / 2 - spec.price
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, j, v, go
    if best is None:
        return value
    _, j, v, go = best
    return j, v, brute_tree(x[go], g[go], h[go], spec, depth + 1), brute_tree(x[~go], g[~go], h[~go], spec, depth + 1)


def nested(t, node=0):
    if t.feature[node] < 0:
        return t.value[node]
    return int(t.feature[node]), t.threshold[node], nested(t, t.left[node]), nested(t, t.right[node])


def flat(n):
    return [round(float(n), 8)] if not isinstance(n, tuple) else [n[0], float(n[1]), *flat(n[2]), *flat(n[3])]


@pytest.mark.parametrize("spec", [T.Growth(3), T.Growth(4, min_rows=9), T.Growth(3, l1=2.0, l2=5.0, price=3.0), T.Growth(5, min_weight=20.0, l2=0.1)])
def test_tree_equals_brute_force(grid, spec):
    x, y, rows = grid
    edges = T.bin_edges(rows, 3)
    t = T.grow(T.binned(rows, edges), edges, lambda b: (-b.y[:, None], np.ones((len(b.y), 1)), np.ones((len(b.y), 1), bool)), [spec])[0]
    assert flat(nested(t)) == flat(brute_tree(x, -y, np.ones(len(y)), spec))
    assert t.cover[0] == 240 and np.allclose(t.predict(x), t.value[t.leaves_of_bins(np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]))])


def test_best_first_with_few_leaves(grid, monkeypatch):
    x, y, rows = grid
    edges = T.bin_edges(rows, 3)
    table_ = T.binned(rows, edges)
    sums = lambda b: (-b.y[:, None].repeat(2, 1), np.ones((len(b.y), 2)), np.ones((len(b.y), 2), bool))
    five, all_ = T.grow(table_, edges, sums, [T.Growth(9, leaves=5), T.Growth(3)])
    assert (five.feature < 0).sum() == 5
    left = lambda t: ((t.predict(x) - y) ** 2).sum()
    # greedy by gain on nested lists
    parts, stumps = [np.arange(240)], T.Growth(1)
    while len(parts) < 5:
        tried = []
        for k, p in enumerate(parts):
            got = brute_tree(x[p], -y[p], np.ones(len(p)), stumps)
            if isinstance(got, tuple):
                go = x[p, got[0]] <= got[1]
                before, after = y[p].var() * len(p), y[p][go].var() * go.sum() + y[p][~go].var() * (~go).sum()
                tried.append((before - after, k, p[go], p[~go]))
        _, k, a, b = max(tried, key=lambda v: v[0])
        parts[k:k + 1] = [a, b]
    assert left(five) == pytest.approx(sum(y[p].var() * len(p) for p in parts))
    monkeypatch.setattr(T, "CELLS", 60)  # waves of single nodes
    assert flat(nested(T.grow(table_, edges, sums, [T.Growth(9, leaves=5), T.Growth(3)])[1])) == flat(nested(all_))


@pytest.mark.parametrize("spec", [T.Growth(12), T.Growth(9, leaves=7, l1=0.1, l2=1.0), T.Growth(8, min_rows=2, columns=(1.0, 0.7, 0.5), seed=(3, 1)), T.Growth(20, min_weight=2.0, price=0.01)])
def test_rows_held_whole_give_the_same_tree_from_one_look(spark, spec):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(700, 3))
    y = np.round(x[:, 0] * 2 + draw.normal(size=700), 2)
    rows = table(spark, x, y)
    edges = T.bin_edges(rows, 3, 500)
    table_ = T.binned(rows, edges)
    looks = []

    def sums(b):
        looks.append(1)
        return -b.y[:, None], np.ones((len(b.y), 1)), (b.fold != 1)[:, None]

    spread = T.grow(table_, edges, sums, [spec])[0]
    assert not looks  # those were the tasks'
    held = T.grow(T.whole(table_, 3), edges, sums, [spec])[0]
    assert len(looks) == 1  # before: one for each level
    assert flat(nested(held)) == flat(nested(spread)) and (held.cover == spread.cover).all()


def test_many_nodes_with_few_rows_each_are_searched_together():
    draw = np.random.default_rng(6)
    place, bins = np.sort(draw.integers(0, 900, 3000)), draw.integers(0, 5000, (2, 3000))
    g, h, allowed = draw.normal(size=3000), draw.random(3000), draw.random((900, 2)) < 0.8
    spec = T.Growth(l2=0.3, min_rows=2)
    gain, column, last = T._best_splits(bins, place, 900, 5000, g, h, spec, allowed)
    for s in range(0, 900, 9):
        own = place == s
        sums = [np.array([np.bincount(bins[j, own], w[own], minlength=5000) for j in range(2)]) for w in (g, h, np.ones(3000))]
        want = T.best_split(*sums, spec, allowed[s])
        assert gain[s] == pytest.approx(want[0]) and (column[s], last[s] if want[1] >= 0 else 0) == want[1:]


def boosted_brute(x, y, p):
    f = np.full(len(y), y.mean())
    for r in range(p.rounds):
        own = B.unit(np.arange(len(y)), p.seed, r) < p.subsample
        tree = brute_tree(x[own], (f - y)[own], np.ones(own.sum()), p.growth(r, 0))
        f = f + p.rate * np.array([value(tree, a) for a in x])
    return f


def value(tree, a):
    while isinstance(tree, tuple):
        tree = tree[2] if a[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("small", [0, B.SMALL])
def test_boosting_equals_brute_force(grid, monkeypatch, small):
    monkeypatch.setattr(B, "STORE", 2)
    monkeypatch.setattr(B, "SMALL", small)
    x, y, rows = grid
    ps = [B.Boosting(rounds=5, rate=0.3, max_depth=2, l1=0.5, l2=1.0, price=0.1), B.Boosting(rounds=3, rate=0.5, max_depth=3, subsample=0.6)]
    for p, got in zip(ps, B.fit_many(rows, [(p, None) for p in ps])):
        assert np.allclose(got.predict(x), boosted_brute(x, y, p))


def test_held_out_fold_is_not_seen(grid):
    x, y, rows = grid
    p = B.Boosting(rounds=2, rate=1.0, max_depth=2)
    some = np.arange(240) % 3 != 1
    got = B.fit_many(rows, [(p, 1)])[0]
    f = np.full(240, y[some].mean())
    for r in range(2):
        tree = brute_tree(x[some], (f - y)[some], np.ones(some.sum()), p.growth(r, 0))
        f = f + np.array([value(tree, a) for a in x])
    assert np.allclose(got.predict(x), f)


def test_classes(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 2)) * 3
    k = np.where(x[:, 0] > 1, 2.0, np.where(x[:, 1] > 0, 5.0, 7.0))
    rows = table(spark, x, k)
    many, two = B.fit_many(rows, [(B.Boosting("softmax", 12, 0.5, 3), None)], [2.0, 5.0, 7.0])[0], B.fit_many(table(spark, x, k == 5), [(B.Boosting("logistic", 12, 0.5, 3), None)], [0.0, 1.0])[0]
    assert (many.predict(x) == k).mean() > 0.97 and len(many.trees[0]) == 3
    assert np.allclose(many.chances(x).sum(axis=1), 1)
    assert (two.predict(x) == (k == 5)).mean() > 0.97


def test_group_quantiles_are_exact(spark):
    draw = np.random.default_rng(2)
    y = np.r_[draw.normal(size=500) * 10.0 ** draw.integers(-9, 9, 500), np.zeros(50), np.full(50, -3.5), [np.inf, -np.inf, -0.0]]
    rows = T.binned(table(spark, np.arange(len(y))[:, None] % 4, y), [np.array([0.0, 1.0, 2.0])])
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = T.group_quantiles(rows, 1, 5, lambda b: [(b.bins[:, 0].astype(int), b.y)], np.full(5, share))
        for g in range(4):
            own = np.sort(y[np.arange(len(y)) % 4 == g])
            assert got[g] == own[max(int(np.ceil(share * len(own))) - 1, 0)]
        assert got[4] == 0


def test_quantiles_of_a_small_table(spark):
    draw = np.random.default_rng(5)
    y, g = draw.normal(size=300), draw.integers(0, 4, 300)
    b = T.Batch(np.arange(300), y, g, g[:, None].astype(np.uint16), None)
    for share in (0.0, 0.3, 1.0):
        got = T.group_quantiles(b, 1, 5, lambda b: [(b.fold, b.y)], share)
        assert got.tolist() == [*(np.sort(y[g == k])[max(int(np.ceil(share * (g == k).sum())) - 1, 0)] for k in range(4)), 0.0]


def test_quantile_and_huber_losses(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 6, (900, 1)).astype(float)
    y = x[:, 0] + draw.exponential(size=900)
    rows = table(spark, x, y)
    q, a = B.fit_many(rows, [(B.Boosting("quantile", 25, 0.3, 3, alpha=0.9), None), (B.Boosting("absolute", 25, 0.3, 3), None)])
    assert 0.87 <= (y <= q.predict(x) + 1e-9).mean() <= 0.93
    assert all(0.8 <= (y <= q.predict(x) + 1e-9)[x[:, 0] == k].mean() <= 1.0 for k in range(6))
    assert 0.45 <= (y <= a.predict(x) + 1e-9).mean() <= 0.55
    wild = y.copy()
    wild[::20] += 1000
    h, s = B.fit_many(table(spark, x, wild), [(B.Boosting("huber", 15, 0.3, 3, alpha=0.9), None), (B.Boosting("squared", 15, 0.3, 3), None)])
    middle = np.array([np.median(y[x[:, 0] == k]) for k in x[:, 0]])
    assert np.abs(h.predict(x) - middle).mean() < 1.0 < np.abs(s.predict(x) - middle).mean()


@pytest.mark.parametrize("small", [0, B.SMALL])
def test_huber_round_by_hand(spark, monkeypatch, small):
    monkeypatch.setattr(B, "SMALL", small)
    y = np.array([0.0, 1, 2, 3, 50, 10, 11, 12, 13, 14])
    x = np.repeat([[0.0], [1.0]], 5, axis=0)
    got = B.fit_many(table(spark, x, y), [(B.Boosting("huber", 1, 1.0, 1, alpha=0.8), None)])[0]
    start = np.sort(y)[4]
    limit = np.sort(np.abs(y - start))[7]
    want = []
    for part in (y[:5], y[5:]):
        miss = part - start
        m = np.sort(miss)[2]
        want.append(start + m + np.clip(miss - m, -limit, limit).mean())
    assert np.allclose(got.predict(x), np.repeat(want, 5))


@pytest.mark.parametrize("small,loss", [(B.SMALL, "linear"), (0, "square"), (B.SMALL, "exponential")])
def test_adaboost_equals_numpy(grid, monkeypatch, small, loss):
    monkeypatch.setattr(B, "STORE", 2)
    monkeypatch.setattr(B, "SMALL", small)
    x, y, rows = grid
    w, trees, weights = np.ones(len(y)), [], []
    for r in range(5):
        tree = brute_tree(x, -w * y, w, T.Growth(1))
        p = np.array([value(tree, a) for a in x])
        miss = B.relative_loss(np.abs(p - y) / np.abs(p - y).max(), loss)
        mean = (w * miss).sum() / w.sum()
        if mean >= 0.5:
            break
        beta = mean / (1 - mean)
        trees.append(p), weights.append(0.7 * np.log(1 / beta))
        w = w * beta ** (0.7 * (1 - miss))
    got = B.fit_adaboost(rows, [(B.Reweighting(5, 0.7, loss, max_depth=1), None)])[0]
    assert np.allclose(got.weights, weights)
    assert np.allclose(got.predict(x), B.weighted_median(np.column_stack(trees), np.array(weights)))


def test_adaboost_ends_on_a_perfect_tree(spark):
    got = B.fit_adaboost(table(spark, [[0], [1], [0], [1]], [2, 3, 2, 3]), [(B.Reweighting(5), None)])[0]
    assert len(got.trees) == 1 and got.predict(np.array([[0.0], [1.0]])).tolist() == [2, 3]


def test_random_thresholds(grid):
    x, y, rows = grid
    one, same, other = (B.fit_extra_trees(rows, 6, 4, min_rows=3, seed=s) for s in (1, 1, 2))
    cuts = lambda f: [t.threshold[t.feature >= 0].tolist() for t in f.trees]
    assert cuts(one) == cuts(same) != cuts(other)
    assert not set(np.concatenate(cuts(one))) & set(np.unique(x))  # drawn, not taken from the values
    for t in one.trees:
        leaf = t.leaves_of(x)
        for k in np.unique(leaf):
            assert t.value[k] == pytest.approx(y[leaf == k].mean()) and t.cover[k] == (leaf == k).sum() >= 3
    full = B.fit_extra_trees(rows, 40, 12)
    assert ((full.predict(x) - y) ** 2).mean() < 0.5 * y.var()
    boot = B.fit_extra_trees(rows, 4, 2, bootstrap=True)
    assert {t.cover[0] for t in boot.trees} != {240.0}


@pytest.mark.parametrize("bootstrap", [False, True])
def test_random_thresholds_of_rows_held_whole(grid, monkeypatch, bootstrap):
    x, y, rows = grid
    args = dict(trees=4, max_depth=6, min_rows=3, share=0.6, bootstrap=bootstrap, fold=2)
    monkeypatch.setattr(B, "SMALL", 0)
    spread = B.fit_extra_trees(rows, **args).trees
    monkeypatch.undo()
    monkeypatch.setattr(B, "_extra_level", None)  # no pass over the table for each level
    for a, b in zip(B.fit_extra_trees(rows, **args).trees, spread):
        assert flat(nested(a)) == flat(nested(b)) and np.allclose(a.cover, b.cover)


def model_rows(spark, x, y):
    from pyspark.ml.functions import array_to_vector

    rows = [(i, i % 4 == 0, i % 3, float(v), list(map(float, a))) for i, (a, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key long, is_test boolean, fold int, label double, x array<double>").withColumn("features", array_to_vector("x"))


def test_base_models_with_three_classes(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(600, 2)) * 3
    k = np.where(x[:, 0] > 1, 2.0, np.where(x[:, 1] > 0, 1.0, 0.0))
    rows = model_rows(spark, x, k)
    lim = MD.Limits(n_trials=3, boosted_round=25, bagging_estimators=12, n_neighbors=8, max_depth=6)
    for name in ("briskxgboost", "briskknn", "briskbagging"):
        got = MD.fit_base(rows, name, lim, classification=True)
        assert got.scores[1] > 0.8, name
    assert MD.fit_base(rows, "sluglgbm", lim, True, "f1_weighted").params["leaves"] == 31
    one = MD.fit_base(model_rows(spark, x, 3 * x[:, 0] + x[:, 1]), "slugxgboost", lim)
    assert len(one.model.trees) == 25 and one.model.classes is None


def test_search_prefers_settings_that_learn(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 2))
    rows = model_rows(spark, x, x[:, 0] * 5)
    good = {"rounds": 10, "rate": 0.5, "max_depth": 3}
    for y, classes, scoring in ((x[:, 0] * 5, None, "r2"), ((x[:, 0] > 0) * 1.0, [0.0, 1.0], "log_loss")):
        rows = model_rows(spark, x, y)
        assert MD._search_boosted(rows, [{**good, "rate": 1e-3}, good], classes, MD.search_scorer(classes is not None, scoring, classes)) == good


def test_settings_follow_the_documented_ranges():
    lim = MD.Limits(n_trials=60)
    for p in MD.sample_params("slugxgboost", lim):
        assert 10 <= p["max_depth"] <= 30 and 1e-3 <= min(p["rate"], p["l1"], p["l2"], p["price"]) and max(p["rate"], p["l1"], p["l2"], p["price"]) <= 0.1 and p["bins"] in MD.XGB_BINS
    assert all(1e-6 <= p["rate"] <= 1 and p["bins"] in MD.LGBM_BINS for p in MD.sample_params("sluglgbm", lim))


@pytest.mark.parametrize("settings", [dict(max_depth=4, l2=0.1), dict(max_depth=20, leaves=9, min_rows=3, columns=(0.7, 1.0, 1.0)), dict(loss="logistic"), dict(loss="softmax")])
def test_rows_that_travel_between_tasks_give_the_same_models(spark, grid, monkeypatch, settings):
    """Tables above the size that the driver sends, up to the size that a task may hold, whose rows are dealt without the driver."""
    x, y, rows = grid
    classes = {"logistic": [0.0, 1.0], "softmax": [0.0, 1.0, 2.0]}.get(settings.get("loss"))
    if classes:
        rows = table(spark, x, np.minimum(np.argsort(np.argsort(y)) * len(classes) // 240, len(classes) - 1))
    models = [(B.Boosting(rounds=4, **settings), fold) for fold in (None, 1)]
    sent = B.fit_many(rows, models, classes)
    monkeypatch.setattr(B, "SMALL", 0)
    held = B.fit_many(rows, models, classes)
    monkeypatch.setattr(B, "HELD", 0)
    spread = B.fit_many(rows, models, classes)
    for a, b, c in zip(sent, held, spread):
        assert np.allclose(a.scores(x), b.scores(x), atol=1e-9) and np.allclose(a.scores(x), c.scores(x), atol=1e-9)


def test_tables_of_some_millions_of_rows_are_held_whole(spark, grid, monkeypatch):
    """A pass over the rows for each level of each round takes too long where a task can hold the rows."""
    rows = grid[2]
    monkeypatch.setattr(B, "SMALL", 0)
    passes = []
    monkeypatch.setattr(T, "sums_of", lambda *a: passes.append(a))
    B.fit_many(rows, [(B.Boosting(rounds=2), None)])
    assert not passes and 6_100_000 * (20 + 4 * 3 + 32) <= B.HELD


def test_wide_levels_are_searched_in_groups_of_nodes(monkeypatch):
    draw = np.random.default_rng(2)
    bins, g = draw.integers(0, 200, (3, 4000)).astype(np.uint16), draw.normal(size=4000)
    edges, leaves = [np.arange(199.0)] * 3, []
    for spec in (T.Growth(9), T.Growth(14, leaves=40, min_rows=5)):
        want = T._grow_whole(bins, g, None, edges, spec, leaves)
        assert (leaves[-1] == want.leaves_of_bins(bins.T)).all()
        with monkeypatch.context() as m:
            m.setattr(T, "CELLS", 1000)
            m.setattr(T, "CHUNK", 100)
            got = T._grow_whole(bins, g, None, edges, spec)
        assert all(np.allclose(a, b) for a, b in zip(T.plain(got), T.plain(want)))
