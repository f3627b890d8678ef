"""Boosted, re-weighted and randomised trees on the passes of ``trees``.

Second-order boosting with l1, l2, a price per split, shares of rows and columns, for squared, logistic and softmax loss; boosting on pseudo-residuals whose leaves are fitted
again by exact quantiles for absolute, huber and quantile loss; AdaBoost.R2; extremely randomised trees. Models of a search, its folds and its classes grow side by side.

A row's scores are stored with it every ``STORE`` rounds; between, the tasks add the trees made since. What rows a round draws follows from their keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut as stored
from .trees import BINS, CELLS, HELD, SMALL, Batch, Growth, Tree, batch_of, bin_edges, binned, grow, group_quantiles, in_tasks, in_tasks_whole, plain, sums_of, unit, whole

STORE = 8


@dataclass
class Boosting:
    """Settings of one model; ``alpha`` is the quantile, and for huber loss the share of rows whose errors count squared."""

    loss: str = "squared"  # squared, absolute, huber, quantile, logistic, softmax
    rounds: int = 100
    rate: float = 0.1
    max_depth: int = 6
    leaves: int | None = None
    min_rows: int = 1
    min_split: int = 2
    min_weight: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    price: float = 0.0
    subsample: float = 1.0
    columns: tuple[float, float, float] = (1.0, 1.0, 1.0)
    alpha: float = 0.9
    bins: int = BINS
    seed: int = 1

    def growth(self, round_: int, k: int) -> Growth:
        refit = self.loss in REFIT
        return Growth(self.max_depth, self.leaves, self.min_rows, self.min_split, self.min_weight, 0.0 if refit else self.l1, 0.0 if refit else self.l2, 0.0 if refit else self.price,
                      self.columns, (self.seed, round_, k))


REFIT = ("absolute", "huber", "quantile")


@dataclass
class Boosted:
    """Scores are start + the trees of every round, one tree per class."""

    params: Boosting
    start: np.ndarray
    classes: np.ndarray | None = None
    trees: list[list[Tree]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.repeat(self.start[None], len(x), axis=0)
        for round_ in self.trees:
            for k, tree in enumerate(round_):
                out[:, k] += tree.predict(x)
        return out

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Probability of each class."""
        return chances(self.scores(x), self.params.loss)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x)[:, 0] if self.classes is None else self.classes[self.chances(x).argmax(axis=1)]


def chances(score: np.ndarray, loss: str) -> np.ndarray:
    if loss == "logistic":
        p = 1 / (1 + np.exp(-np.clip(score[:, 0], -700, 700)))
        return np.column_stack([1 - p, p])
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(score: np.ndarray, y: np.ndarray, p: Boosting, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature [rows, trees]; for the losses with fitted leaves minus the pseudo-residual and 1. ``y`` holds class numbers for the class losses."""
    if p.loss == "logistic":
        q = chances(score, p.loss)[:, 1:]
        return q - y[:, None], np.maximum(q * (1 - q), 1e-16)
    if p.loss == "softmax":
        q = chances(score, p.loss)
        return q - (y[:, None] == np.arange(score.shape[1])), np.maximum(q * (1 - q), 1e-16)
    miss = score - y[:, None]
    if p.loss == "absolute":
        miss = np.sign(miss)
    elif p.loss == "huber":
        miss = np.clip(miss, -limit, limit)
    elif p.loss == "quantile":
        miss = np.where(miss < 0, -p.alpha, 1 - p.alpha)
    return miss, np.ones_like(miss)


def fit_many(rows: DataFrame, models: list[tuple[Boosting, int | None]], classes: list[float] | None = None) -> list[Boosted]:
    """One model per (settings, fold that it must not see); ``rows`` has key, label, fold and x. Settings with equal bins grow together."""
    out: list[Boosted | None] = [None] * len(models)
    for bins in sorted({p.bins for p, _ in models}):
        mine = [i for i, (p, _) in enumerate(models) if p.bins == bins]
        for i, m in zip(mine, _fit_group(rows, [models[i] for i in mine], bins, classes)):
            out[i] = m
    return out


def _fit_group(rows: DataFrame, models: list[tuple[Boosting, int | None]], bins: int, classes: list[float] | None) -> list[Boosted]:
    d = len(rows.select("x").first()["x"])
    edges = bin_edges(rows, d, bins)
    table = binned(rows, edges)
    names = np.array(sorted(classes)) if classes is not None else None
    if names is not None:
        spots = F.array_position(F.array(*map(F.lit, names.tolist())), F.col("label")) - 1
        table = table.withColumn("label", spots.cast("double"))
    spark, n = rows.sparkSession, table.count()
    trees = max([1 if p.loss != "softmax" else len(names) for p, _ in models], default=1)

    def fit(i: int, b: Batch):
        m = _lockstep(b, d, edges, [models[i]], names)[0]
        return m.start, [[plain(t) for t in round_] for round_ in m.trees]

    # checked sizes: each model in a task of its own. Larger tables only for losses that need no quantiles, whose values are sorted
    if n * d <= SMALL:
        sent = spark.sparkContext.broadcast(plain(whole(table, d)))
        made = in_tasks(spark, len(models), lambda i: fit(i, Batch(*sent.value)))
    elif n * (20 + 4 * d + 32 * trees) <= HELD and all(p.loss not in REFIT for p, _ in models):
        made = in_tasks_whole(table, d, [fold for _, fold in models], fit)
    else:
        return _lockstep(table, d, edges, models, names)
    return [Boosted(p, start, names, [[Tree(*t) for t in round_] for round_ in trees]) for (p, _), (start, trees) in zip(models, made)]


def _lockstep(table: DataFrame | Batch, d: int, edges: list[np.ndarray], models: list[tuple[Boosting, int | None]], names: np.ndarray | None) -> list[Boosted]:
    """All models by the same passes over the rows."""
    width = [1 if p.loss != "softmax" else len(names) for p, _ in models]
    at = np.cumsum([0, *width])
    seen = lambda b, fold: np.ones(len(b.y), bool) if fold is None else b.fold != fold
    out = [Boosted(p, s, names) for (p, _), s in zip(models, _starts(table, d, models, width, seen))]
    fresh: list[list[list[Tree]]] = [[] for _ in models]  # trees that the stored scores do not hold

    def scores(b: Batch) -> np.ndarray:
        f = np.concatenate([m.start for m in out])[None].repeat(len(b.y), axis=0) if b.state is None else b.state.copy()
        for i, rounds in enumerate(fresh):
            for round_ in rounds:
                for k, tree in enumerate(round_):
                    f[:, at[i] + k] += tree.value[tree.leaves_of_bins(b.bins)]
        return f

    for r in range(max([p.rounds for p, _ in models], default=0)):
        live = [i for i, (p, _) in enumerate(models) if r < p.rounds]
        limits = _limits(table, d, [i for i in live if models[i][0].loss == "huber"], models, scores, at, seen)

        def sums(b: Batch):
            f = scores(b)
            g, h, m = [], [], []
            for i in live:
                p, fold = models[i]
                gi, hi = gradients(f[:, at[i]:at[i + 1]], b.y, p, limits.get(i, np.inf))
                own = seen(b, fold)
                if p.subsample < 1:
                    own = own & (unit(b.key, p.seed, r) < p.subsample)
                g.append(gi), h.append(hi), m.append(np.repeat(own[:, None], width[i], axis=1))
            return np.hstack(g), np.hstack(h), np.hstack(m)

        leaves = []
        made = grow(table, edges, sums, [models[i][0].growth(r, k) for i in live for k in range(width[i])], leaves)
        groups = {i: [made.pop(0) for _ in range(width[i])] for i in live}
        _refit(table, d, {i: groups[i][0] for i in live if models[i][0].loss in REFIT}, models, scores, at, sums, live, limits)
        for i, trees in groups.items():
            for tree in trees:
                tree.value = tree.value * models[i][0].rate
            out[i].trees.append(trees), fresh[i].append(trees)
        if isinstance(table, Batch):  # rows held whole keep their scores and know their leaves
            fresh = [[] for _ in models]
            state = scores(table)
            for at_tree, tree, leaf in zip([at[i] + k for i in live for k in range(width[i])], [t for i in live for t in groups[i]], leaves):
                state[:, at_tree] += tree.value[leaf]
            table = replace(table, state=state)
        elif (r + 1) % STORE == 0:
            table = _store(table, d, scores)
            fresh = [[] for _ in models]
    return out


def _starts(table, d, models, width, seen) -> list[np.ndarray]:
    """Mean, quantile or log odds of the labels that each model may see."""
    exact = [i for i, (p, _) in enumerate(models) if p.loss in REFIT]
    most = max(width, default=1)

    def add(b: Batch, own: dict) -> None:
        for i, (p, fold) in enumerate(models):
            y = b.y[seen(b, fold)]
            own["n"][i] += len(y)
            own["s"][i] += y.sum()
            if p.loss == "softmax":
                own["k"][i] += np.bincount(y.astype(int), minlength=most)

    got = sums_of(table, d, add, {"n": (len(models),), "s": (len(models),), "k": (len(models), most)})
    share = np.array([models[i][0].alpha if models[i][0].loss == "quantile" else 0.5 for i in exact])
    middle = dict(zip(exact, group_quantiles(table, d, len(exact), lambda b: ((np.full(int(s.sum()), g), b.y[s]) for g, i in enumerate(exact) for s in [seen(b, models[i][1])]), share))) if exact else {}
    out = []
    for i, (p, _) in enumerate(models):
        mean = got["s"][i] / max(got["n"][i], 1)
        if p.loss == "logistic":
            q = np.clip(mean, 1e-9, 1 - 1e-9)
            out.append(np.array([np.log(q / (1 - q))]))
        elif p.loss == "softmax":
            out.append(np.log(np.clip(got["k"][i][:width[i]] / max(got["n"][i], 1), 1e-9, 1)))
        else:
            out.append(np.array([middle.get(i, mean)]))
    return out


def _limits(table, d, which, models, scores, at, seen) -> dict[int, float]:
    """Error up to which huber loss is squared: the exact ``alpha`` quantile of the absolute errors."""
    if not which:
        return {}

    def values(b: Batch):
        f = scores(b)
        for g, i in enumerate(which):
            own = seen(b, models[i][1])
            yield np.full(int(own.sum()), g), np.abs(b.y - f[:, at[i]])[own]

    return dict(zip(which, group_quantiles(table, d, len(which), values, np.array([models[i][0].alpha for i in which]))))


def _refit(table, d, trees: dict[int, Tree], models, scores, at, sums, live, limits) -> None:
    """Leaf values from the errors of the round's rows in each leaf: their quantile, for huber loss corrected by the mean of the clipped rest."""
    if not trees:
        return
    first = dict(zip(trees, np.cumsum([0, *[len(t.value) for t in trees.values()]])))
    total = sum(len(t.value) for t in trees.values())
    column = dict(zip(live, np.cumsum([0, *[at[i + 1] - at[i] for i in live]])))
    share = np.concatenate([np.full(len(t.value), models[i][0].alpha if models[i][0].loss == "quantile" else 0.5) for i, t in trees.items()])

    def values(b: Batch):
        f, m = scores(b), sums(b)[2]
        for i, tree in trees.items():
            own = m[:, column[i]]
            yield first[i] + tree.leaves_of_bins(b.bins[own]), (b.y - f[:, at[i]])[own]

    middle = group_quantiles(table, d, total, values, share)
    huber = [i for i in trees if models[i][0].loss == "huber"]
    if huber:
        def add(b: Batch, own: dict) -> None:
            for i, (leaf, miss) in zip(trees, values(b)):
                if i in huber:
                    rest = miss - middle[leaf]
                    own["s"] += np.bincount(leaf, np.clip(rest, -limits[i], limits[i]), minlength=total)
                    own["n"] += np.bincount(leaf, minlength=total)

        got = sums_of(table, d, add, {"s": (total,), "n": (total,)})
        middle = middle + got["s"] / np.maximum(got["n"], 1)
    for i, tree in trees.items():
        tree.value = middle[first[i]:first[i] + len(tree.value)].copy()


def _store(table: DataFrame | Batch, d: int, scores) -> DataFrame | Batch:
    """The table with its rows' scores."""
    if isinstance(table, Batch):
        return replace(table, state=scores(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state = scores(batch_of(b, d)) if len(b) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in BASE), pa.array([r.tobytes() for r in state], pa.binary())], names=[*BASE, "state"])

    return stored(table.mapInArrow(run, "key long, label double, fold int, bins binary, state binary"), "scores")


BASE = ["key", "label", "fold", "bins"]


# ---- AdaBoost.R2 -------------------------------------------------------------------------------

@dataclass
class AdaBoosted:
    """The prediction is the median of the trees' values, weighted by log(1 / beta)."""

    trees: list[Tree]
    weights: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return weighted_median(np.column_stack([t.predict(x) for t in self.trees]), np.array(self.weights))


def weighted_median(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    order = np.argsort(values, axis=1, kind="stable")
    upto = weights[order].cumsum(axis=1)
    place = np.argmax(upto >= 0.5 * upto[:, -1:], axis=1)
    rows = np.arange(len(values))
    return values[rows, order[rows, place]]


def relative_loss(miss: np.ndarray, kind: str) -> np.ndarray:
    """Loss of errors that were divided by the largest one."""
    return {"linear": miss, "square": miss**2, "exponential": 1 - np.exp(-miss)}[kind]


@dataclass
class Reweighting:
    """Settings of AdaBoost.R2."""

    rounds: int = 100
    rate: float = 1.0
    loss: str = "linear"  # linear, square, exponential
    max_depth: int = 3
    min_rows: int = 1
    seed: int = 1


def fit_adaboost(rows: DataFrame, models: list[tuple[Reweighting, int | None]], bins: int = BINS) -> list[AdaBoosted]:
    """One model per (settings, fold that it must not see). Trees on re-weighted rows: what is predicted well loses weight by beta ** (1 - loss).

    A model ends when the mean loss reaches 1/2 or nothing is missed.
    """
    d = len(rows.select("x").first()["x"])
    edges = bin_edges(rows, d, bins)
    table = binned(rows, edges)
    if table.count() * d <= SMALL:
        sent = rows.sparkSession.sparkContext.broadcast(plain(whole(table, d)))

        def fit(i: int):
            m = _reweighted(Batch(*sent.value), d, edges, *models[i])
            return [plain(t) for t in m.trees], m.weights

        return [AdaBoosted([Tree(*t) for t in trees], weights) for trees, weights in in_tasks(rows.sparkSession, len(models), fit)]
    return [_reweighted(table, d, edges, p, fold) for p, fold in models]


def _reweighted(table: DataFrame | Batch, d: int, edges: list[np.ndarray], p: Reweighting, fold: int | None) -> AdaBoosted:
    rate, loss = p.rate, p.loss
    out = AdaBoosted([], [])
    fresh: list[tuple[Tree, float, float]] = []  # tree, largest error, log beta

    def weights(b: Batch) -> np.ndarray:
        log = np.zeros((len(b.y), 1)) if b.state is None else b.state.copy()
        for tree, most, beta in fresh:
            log[:, 0] += rate * (1 - relative_loss(np.abs(tree.value[tree.leaves_of_bins(b.bins)] - b.y) / most, loss)) * beta
        return log

    def sums(b: Batch):
        w = np.exp(weights(b))
        return -w * b.y[:, None], w, (np.ones(len(b.y), bool) if fold is None else b.fold != fold)[:, None]

    for r in range(p.rounds):
        tree = grow(table, edges, sums, [Growth(p.max_depth, None, p.min_rows, seed=(p.seed, r))])[0]

        def errors(b: Batch):
            _, w, m = sums(b)
            own = m[:, 0]
            return np.abs(tree.value[tree.leaves_of_bins(b.bins[own])] - b.y[own]), w[own, 0]

        most = float(group_quantiles(table, d, 1, lambda b: [(np.zeros(len(e), int), e) for e, _ in [errors(b)]], 1.0)[0])
        if most <= 0:  # every row is met: this tree alone decides
            return AdaBoosted([tree], [1.0])

        def add(b: Batch, own: dict) -> None:
            miss, w = errors(b)
            own["s"] += np.array([(w * relative_loss(miss / most, loss)).sum(), w.sum()])

        missed, total = sums_of(table, d, add, {"s": (2,)})["s"]
        mean = missed / total
        if mean >= 0.5:
            if not out.trees:
                out = AdaBoosted([tree], [1.0])
            return out
        beta = np.log(mean / (1 - mean))
        out.trees.append(tree), out.weights.append(-rate * beta), fresh.append((tree, most, beta))
        if isinstance(table, Batch) or (r + 1) % STORE == 0:
            table = _store(table, d, weights)
            fresh = []
    return out


# ---- extremely randomised trees ----------------------------------------------------------------

@dataclass
class Forest:
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def fit_extra_trees(rows: DataFrame, trees: int = 100, max_depth: int = 20, min_rows: int = 1, min_split: int = 2, share: float = 1.0, bootstrap: bool = False, fold: int | None = None, seed: int = 1) -> Forest:
    """Trees whose thresholds are drawn between the node's own least and largest value of a column; the best of the drawn columns splits.

    All trees take a level in two passes over the rows: least and largest values, then the sums left of the drawn thresholds. A table of small checked size is sent
    to tasks that grow whole trees, with the same draws.
    """
    d = len(rows.select("x").first()["x"])
    src = rows.select(F.col("key").cast("long"), F.col("label").cast("double"), F.col("fold").cast("int"), F.col("x").cast("array<double>"))
    src = stored(src if fold is None else src.where(F.col("fold") != fold), "extra")
    if src.count() * d <= SMALL:
        got = src.orderBy("key", "label", "x").toArrow().combine_chunks()
        key, y = (got[c].to_numpy() for c in ("key", "label"))
        sent = rows.sparkSession.sparkContext.broadcast((key, y, pc.list_flatten(got["x"]).to_numpy().reshape(-1, d)))
        made = in_tasks(rows.sparkSession, trees, lambda t: plain(_extra_tree(*sent.value, t, max_depth, min_rows, min_split, share, bootstrap, seed)))
        return Forest([Tree(*t) for t in made])
    grown = [{"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "sums": {}} for _ in range(trees)]
    level = [(t, 0) for t in range(trees)]
    for depth in range(max_depth + 1):
        following = []
        for a in range(0, len(level), max(1, CELLS // (8 * d))):
            following += _extra_level(src, d, grown, level[a:a + max(1, CELLS // (8 * d))], depth, depth == max_depth, min_rows, min_split, share, bootstrap, seed)
        level = following
        if not level:
            break
    out = []
    for g in grown:
        mean = np.array([g["sums"][i][1] / g["sums"][i][0] if g["sums"][i][0] else 0.0 for i in range(len(g["feature"]))])
        out.append(Tree(np.array(g["feature"]), np.zeros(len(mean), int), np.array(g["threshold"]), np.array(g["left"]), np.array(g["right"]), mean, np.array([g["sums"][i][0] for i in range(len(mean))])))
    return Forest(out)


def _extra_tree(key: np.ndarray, y: np.ndarray, x: np.ndarray, t: int, max_depth: int, min_rows: int, min_split: int, share: float, bootstrap: bool, seed: int) -> Tree:
    """Tree ``t`` over rows that a task holds whole: the nodes of ``_extra_level``, a level at once."""
    d = x.shape[1]
    w = np.searchsorted(POISSON, unit(key, seed, t), side="right").astype(float) if bootstrap else np.ones(len(x))
    drawn = np.flatnonzero(w > 0)
    x, y, w = np.ascontiguousarray(x[drawn].T), y[drawn], w[drawn]
    feature, threshold, left, right, cover, value = [np.array([v]) for v in (-1, 0.0, -1, -1, 0.0, 0.0)]
    node_of, level = np.zeros(len(y), np.int64), np.array([0])
    for depth in range(max_depth + 1):
        m = len(level)
        slot = np.full(len(feature), -1)
        slot[level] = np.arange(m)
        place = slot[node_of]
        rows = np.flatnonzero(place >= 0)
        rows = rows[np.argsort(place[rows], kind="stable")]
        place = place[rows]
        if not len(rows):
            break
        yw, ww = y[rows], w[rows]
        n, sy, syy = (np.bincount(place, v, minlength=m) for v in (ww, ww * yw, ww * yw * yw))
        cover[level], value[level] = n, sy / np.where(n > 0, n, 1.0)
        if depth == max_depth:
            break
        # every node but an empty root has rows
        start = np.searchsorted(place, np.arange(m))
        low, high = (np.column_stack([f.reduceat(v[rows], start) for v in x]) for f in (np.minimum, np.maximum))
        stay = (n < max(min_split, 2 * min_rows)) | (syy - sy * sy / n <= 1e-12 * np.maximum(np.abs(syy), 1e-300))
        thresholds = np.full((m, d), np.nan)
        for s in np.flatnonzero(~stay):
            draw = np.random.default_rng([seed, t, depth, int(level[s])])
            chosen = draw.permutation(np.flatnonzero(high[s] > low[s]))[:max(1, int(np.ceil(share * d)))]
            thresholds[s, chosen] = low[s, chosen] + draw.random(len(chosen)) * (high[s, chosen] - low[s, chosen])
        thresholds = np.minimum(thresholds, np.nextafter(high, -np.inf))
        open_ = ~np.isnan(thresholds)
        if not open_.any():
            break
        gain = np.full((m, d), -np.inf)
        for j in range(d):
            go = x[j, rows] <= thresholds[place, j]
            nl, yl = (np.bincount(place[go], v[go], minlength=m) for v in (ww, ww * yw))
            good = open_[:, j] & (np.minimum(nl, n - nl) >= max(min_rows, 1))
            gain[:, j] = np.where(good, yl**2 / np.maximum(nl, 1) + (sy - yl) ** 2 / np.maximum(n - nl, 1), -np.inf)
        split = np.flatnonzero((gain > -np.inf).any(axis=1))
        best, node = gain[split].argmax(axis=1), level[split]
        kids = len(feature) + 2 * np.arange(len(split))
        feature[node], threshold[node], left[node], right[node] = best, thresholds[split, best], kids, kids + 1
        feature, threshold, left, right, cover, value = (np.concatenate([v, np.full(2 * len(split), fill, v.dtype)]) for v, fill in zip((feature, threshold, left, right, cover, value), (-1, 0, -1, -1, 0, 0)))
        rows = rows[feature[node_of[rows]] >= 0]
        at = node_of[rows]
        node_of[rows] = np.where(x[feature[at], rows] <= threshold[at], left[at], right[at])
        level = np.arange(len(feature) - 2 * len(split), len(feature))
        if not len(split):
            break
    return Tree(feature, np.zeros(len(feature), int), threshold, left, right, value, cover)


def _extra_level(src: DataFrame, d: int, grown: list[dict], wave: list[tuple[int, int]], depth: int, last: bool, min_rows: int, min_split: int, share: float, bootstrap: bool, seed: int) -> list[tuple[int, int]]:
    """Splits the nodes of a wave; gives the children."""
    slots: dict[int, np.ndarray] = {}
    for s, (t, node) in enumerate(wave):
        slots.setdefault(t, np.full(len(grown[t]["feature"]), -1))[node] = s
    arrays = {t: Tree(np.array(g["feature"]), None, np.array(g["threshold"]), np.array(g["left"]), np.array(g["right"]), None, None) for t in slots for g in [grown[t]]}
    m = len(wave)

    def places(b: pa.RecordBatch):
        """Per tree: places of its rows in the wave, values, labels and how often the tree drew each."""
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        y, key = b.column("label").to_numpy(zero_copy_only=False), b.column("key").to_numpy(zero_copy_only=False)
        for t, slot in slots.items():
            at = slot[arrays[t].leaves_of(x)]
            times = np.searchsorted(POISSON, unit(key, seed, t), side="right") if bootstrap else np.ones(len(x), int)
            own = np.flatnonzero((at >= 0) & (times > 0))
            yield at[own], x[own], y[own], times[own].astype(float)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, sums = np.full((m, d), np.inf), np.full((m, d), -np.inf), np.zeros((m, 3))
        for b in batches:
            for at, x, y, w in places(b):
                np.minimum.at(low, at, x)
                np.maximum.at(high, at, x)
                for k, v in enumerate((w, w * y, w * y * y)):
                    sums[:, k] += np.bincount(at, v, minlength=m)
        there = np.flatnonzero(sums[:, 0])
        if len(there):
            yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(v[there, j]) for v in (low, high) for j in range(d)), *(pa.array(sums[there, k]) for k in range(3))], names=cols)

    cols = ["s", *[f"lo{j}" for j in range(d)], *[f"hi{j}" for j in range(d)], "n", "y", "yy"]
    aggs = [F.min(f"lo{j}").alias(f"lo{j}") for j in range(d)] + [F.max(f"hi{j}").alias(f"hi{j}") for j in range(d)] + [F.sum(c).alias(c) for c in ("n", "y", "yy")]
    got = src.mapInArrow(spans, "s long, " + ", ".join(f"{c} double" for c in cols[1:])).groupBy("s").agg(*aggs).toPandas().set_index("s")
    low, high = got[[f"lo{j}" for j in range(d)]].to_numpy(), got[[f"hi{j}" for j in range(d)]].to_numpy()
    thresholds = np.full((m, d), np.nan)
    for i, s in enumerate(got.index):
        t, node = wave[s]
        n, y, yy = got.loc[s, ["n", "y", "yy"]]
        grown[t]["sums"][node] = n, y
        if last or n < max(min_split, 2 * min_rows) or yy - y * y / n <= 1e-12 * max(abs(yy), 1e-300):
            continue
        draw = np.random.default_rng([seed, t, depth, node])
        wide = np.flatnonzero(high[i] > low[i])
        chosen = draw.permutation(wide)[:max(1, int(np.ceil(share * d)))]
        thresholds[s, chosen] = low[i, chosen] + draw.random(len(chosen)) * (high[i, chosen] - low[i, chosen])
        thresholds[s, chosen] = np.minimum(thresholds[s, chosen], np.nextafter(high[i, chosen], -np.inf))
    if np.isnan(thresholds).all():
        return []

    def lefts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((m, d, 2))
        for b in batches:
            for at, x, y, w in places(b):
                go = x <= thresholds[at]
                for j in range(d):
                    for k, v in enumerate((w, w * y)):
                        own[:, j, k] += np.bincount(at[go[:, j]], v[go[:, j]], minlength=m)
        s, j = np.nonzero(own[:, :, 0])
        if len(s):
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(j), pa.array(own[s, j, 0]), pa.array(own[s, j, 1])], names=["s", "j", "n", "y"])

    left = np.zeros((m, d, 2))
    sides = src.mapInArrow(lefts, "s long, j long, n double, y double").groupBy("s", "j").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas()
    left[sides["s"], sides["j"]] = sides[["n", "y"]].to_numpy()
    children = []
    for s, (t, node) in enumerate(wave):
        own = ~np.isnan(thresholds[s])
        n, y = grown[t]["sums"].get(node, (0.0, 0.0))
        nl, yl = left[s, :, 0], left[s, :, 1]
        good = own & (np.minimum(nl, n - nl) >= max(min_rows, 1))
        if not good.any():
            continue
        gain = np.where(good, yl**2 / np.maximum(nl, 1) + (y - yl) ** 2 / np.maximum(n - nl, 1), -np.inf)
        j = int(gain.argmax())
        g = grown[t]
        kids = len(g["feature"]), len(g["feature"]) + 1
        g["feature"][node], g["threshold"][node], g["left"][node], g["right"][node] = j, float(thresholds[s, j]), *kids
        for name, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1)):
            g[name] += [v, v]
        children += [(t, kids[0]), (t, kids[1])]
    return children


# how often a bootstrap of many rows draws one row: bounds of a Poisson distribution with mean 1
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
