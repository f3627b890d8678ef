"""Base models, parameter search, scores and stacking for the relevance task.

Rows have ``key BIGINT, x ARRAY<DOUBLE>, features VECTOR, label DOUBLE, fold INT, is_test BOOLEAN``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions import metrics as M
from ..session import cut
from .boosting import Boosted, Boosting, fit_many
from .matrix import map_rows
from .neighbors import Means, best_of, mean_of, nearest, vote_of

MODEL_NAMES = ["briskbagging", "briskknn", "briskxgboost", "slugxgboost", "sluglgbm", "slugrf"]
BOOSTED = ("briskxgboost", "slugxgboost", "sluglgbm")
MAX_TREE_DEPTH = 30  # Spark's own limit
# fixed values: sizes of histograms that the searches choose from
XGB_BINS = [64, 128, 512, 1024, 2048, 3072]
LGBM_BINS = [64, 128, 512, 1024, 2048, 3072, 4096, 8192]


@dataclass
class Limits:
    """Upper ends of the sampled ranges."""

    n_trials: int = 100
    boosted_round: int = 100
    max_depth: int = 30
    rf_n_estimators: int = 1500
    bagging_estimators: int = 100
    n_neighbors: int = 30
    cv_splits: int = 3
    seed: int = 1
    parallelism: int = 4


def feature_rows(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    x = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select("key", "is_test", "fold", F.col(label).cast("double").alias("label"), x.alias("x"), array_to_vector(x).alias("features"))


def sample_params(name: str, lim: Limits) -> list[dict]:
    """Seeded draws: integers uniform, rates log-uniform. Equal draws are kept once."""
    rng = np.random.default_rng([lim.seed, sum(map(ord, name))])

    def whole(lo, hi):
        return int(rng.integers(min(lo, hi), max(lo, hi) + 1))

    def rate(lo, hi):
        return float(np.exp(rng.uniform(np.log(lo), np.log(hi))))

    def penalties():
        return {"l1": rate(1e-3, 0.1), "l2": rate(1e-3, 0.1), "seed": lim.seed}

    depth = min(lim.max_depth, MAX_TREE_DEPTH)
    draw = {
        "briskbagging": lambda: {"numTrees": whole(10, lim.bagging_estimators), "maxDepth": depth},
        "briskknn": lambda: {"k": whole(5, lim.n_neighbors), "weights": ["uniform", "distance"][whole(0, 1)]},
        "briskxgboost": lambda: {**penalties(), "max_depth": whole(3, min(9, depth)), "rate": rate(1e-3, 0.1), "price": rate(1e-3, 0.1), "min_weight": 1.0, "rounds": lim.boosted_round},
        "slugxgboost": lambda: {**penalties(), "max_depth": whole(min(10, depth), depth), "rate": rate(1e-3, 0.1), "price": rate(1e-3, 0.1), "min_weight": 1.0, "rounds": lim.boosted_round,
                                "columns": (rate(1e-8, 1.0), rate(1e-8, 1.0), rate(1e-8, 1.0)), "bins": XGB_BINS[whole(0, len(XGB_BINS) - 1)]},
        "sluglgbm": lambda: {**penalties(), "max_depth": whole(3, depth), "rate": rate(1e-6, 1.0), "leaves": 31, "min_rows": 20, "min_weight": 1e-3, "rounds": lim.boosted_round,
                             "subsample": rate(1e-6, 1.0), "columns": (rate(1e-6, 1.0), 1.0, 1.0), "bins": LGBM_BINS[whole(0, len(LGBM_BINS) - 1)]},
        "slugrf": lambda: {"numTrees": whole(50, lim.rf_n_estimators), "maxDepth": whole(min(10, depth), depth),
                           "minInstancesPerNode": whole(11, 60)},
    }[name]
    out = []
    for _ in range(lim.n_trials):
        p = draw()
        if p not in out:
            out.append(p)
    return out


def build_estimator(name: str, classification: bool, seed: int):
    """Bagged trees: all features at every split and bootstrapped rows. Boosted and neighbour models have no estimator."""
    if name not in ("briskbagging", "slugrf"):
        raise ValueError(f"{name} is no model of bagged trees")
    kind = RandomForestClassifier if classification else RandomForestRegressor
    return kind(featureSubsetStrategy="all", subsamplingRate=1.0, seed=seed)


def label_classes(rows: DataFrame, most: int = 1000) -> list[float]:
    """The labels, rising; a label with more values than ``most`` is no class."""
    got = [r[0] for r in rows.select("label").distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} different labels: not a classification")
    return sorted(got)


def search_scorer(classification: bool, scoring, classes: list[float] | None = None):
    """Aggregate of (truth, prediction, probability of the true label) by which settings are compared: larger is better.

    ``scoring`` is a name or a callable (truth, prediction) -> aggregate Column; an unknown name is an error.
    """
    if callable(scoring):
        return lambda y, p, q: scoring(y, p)
    if not classification:
        named = M.resolve_scorer(scoring)
        return lambda y, p, q: named(y, p)
    if scoring == "log_loss":
        return lambda y, p, q: -M.log_loss_given(q)
    if scoring == "f1":
        return lambda y, p, q: default_scorer(True, classes)(y, p)
    if scoring in ("f1_macro", "f1_weighted", "f1_micro"):
        return lambda y, p, q: M.f1_classes(y, p, classes or [0.0, 1.0], scoring[3:])
    raise ValueError(f"unknown scoring {scoring!r}; known: ['f1', 'f1_macro', 'f1_micro', 'f1_weighted', 'log_loss'] or a callable")


def _search_trees(est, train: DataFrame, params: list[dict], classification: bool, scorer, parallelism: int) -> dict:
    """Best settings by the mean score over the hash folds; each fit is scored by one aggregate, several fits run side by side."""
    folds = sorted(r[0] for r in train.select("fold").distinct().collect())

    def one(task):
        p, f = task
        model = est.fit(train.where(F.col("fold") != f), {est.getParam(k): v for k, v in p.items()})
        got = model.transform(train.where(F.col("fold") == f))
        chance = F.lit(None).cast("double")
        if classification and "probability" in got.columns:
            # a label that the other folds do not hold has no probability
            chance = F.coalesce(F.get(vector_to_array("probability"), F.col("label").cast("int")), F.lit(0.0))
        return got.select("label", "prediction", chance.alias("__q")).agg(scorer(F.col("label"), F.col("prediction"), F.col("__q"))).first()[0]

    with ThreadPool(max(1, parallelism)) as pool:
        scores = pool.map(one, [(p, f) for p in params for f in folds])
    return _best_mean(params, [scores[i * len(folds):(i + 1) * len(folds)] for i in range(len(params))])


def _best_mean(params: list[dict], scores: list[list]) -> dict:
    means = [[s for s in own if s is not None and not np.isnan(s)] for own in scores]
    return params[int(np.argmax([np.mean(m) if m else -np.inf for m in means]))]


def boosting_params(p: dict, classes: list[float] | None) -> Boosting:
    return Boosting(loss="squared" if classes is None else "logistic" if len(classes) <= 2 else "softmax", **p)


def _search_boosted(train: DataFrame, params: list[dict], classes: list[float] | None, scorer) -> dict:
    """All settings and folds grow side by side; every row is predicted by the models that have not seen its fold, in one pass."""
    folds = sorted(r[0] for r in train.select("fold").distinct().collect())
    models = fit_many(train, [(boosting_params(p, classes), f) for p in params for f in folds], classes)
    n, k = len(params), len(folds)

    def predict(x: np.ndarray) -> np.ndarray:
        """Per row of fold number and inputs: predictions of all settings, and the probability of the row's label."""
        fold, label, x = x[:, 0], x[:, 1], x[:, 2:]
        out = np.zeros((len(x), 2 * n))
        for j, f in enumerate(folds):
            mine = np.flatnonzero(fold == f)
            for i in range(n):
                m = models[i * k + j]
                out[mine, i] = m.predict(x[mine])
                if classes is not None:
                    out[mine, n + i] = m.chances(x[mine])[np.arange(len(mine)), np.searchsorted(m.classes, label[mine])]
        return out

    rows = train.select("fold", "label", F.concat(F.array(F.col("fold").cast("double"), "label"), "x").alias("x"))
    got = cut(map_rows(rows, predict, "__p").drop("x"), "boosted")
    aggs = [scorer(F.col("label"), F.col("__p")[i], F.col("__p")[n + i]).alias(f"s{i}") for i in range(n)]
    by_fold = got.groupBy("fold").agg(*aggs).collect()
    return _best_mean(params, [[r[f"s{i}"] for r in by_fold] for i in range(n)])


@dataclass
class FittedModel:
    name: str
    params: dict
    classification: bool
    model: Model | Boosted | None = None
    base: DataFrame | None = None  # training rows of a neighbour model
    scores: list[float] = field(default_factory=list)

    def explained(self) -> int:
        """Which output attributions explain: the score of a two-class boosted model, else the last class's, or the value."""
        if isinstance(self.model, Boosted):
            return len(self.model.start) - 1
        return self.model.numClasses - 1 if self.classification else 0

    def predict(self, rows: DataFrame, out: str = "p") -> DataFrame:
        """Add the predicted value or label to rows that have ``key, x, features``."""
        if isinstance(self.model, Boosted):
            keep, model = rows.columns, self.model
            got = map_rows(rows.drop("features"), lambda x: model.predict(x)[:, None], "__p").withColumn(out, F.col("__p")[0])
            return (got.withColumn("features", array_to_vector("x")) if "features" in keep else got).select(*keep, out)
        if self.model is not None:
            keep = rows.columns
            return self.model.transform(rows).select(*keep, F.col("prediction").alias(out))
        q = rows.select(F.lit(0).alias("gid"), "key", "x")
        nn = nearest(q, self.base, self.params["k"])
        near = best_of("nn", self.params["k"])
        p = vote_of(near) if self.classification else mean_of(near, 0, self.params["weights"])
        return rows.join(nn.select("key", p.alias(out)), "key")


def _knn_base(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(0).alias("gid"), "key", "x", F.lit(0).alias("part"), F.array("label").alias("y"))


def _fit_knn(rows: DataFrame, params: list[dict], scorer, metric) -> tuple[dict, list[float]]:
    """Best setting of a regression by neighbours, and its scores on both sides: one search gives every row the means of all settings, over all training rows and with each fold left out."""
    train = rows.where(~F.col("is_test"))
    folds = sorted(r[0] for r in train.select("fold").distinct().collect())
    means = Means(sorted({p["k"] for p in params}), folds, 1, tuple(sorted({p["weights"] for p in params}, reverse=True)))
    q = rows.select(F.lit(0).alias("gid"), "key", "x", F.col("fold").cast("double").alias("fold"), "label", F.col("is_test").cast("double").alias("is_test"))
    base = train.select(F.lit(0).alias("gid"), "key", "x", F.col("fold").cast("int").alias("part"), F.array("label").alias("y"))
    got = cut(nearest(q, base, max(p["k"] for p in params), carry=("fold", "label", "is_test"), means=means), "knn_search")
    name = lambda p, f=None: ("m" if p["weights"] == "uniform" else "w") + f"{p['k']}" + ("" if f is None else f"_{f}") + "_0"

    def unseen(p):
        return F.coalesce(*[F.when(F.col("fold") == f, F.col(name(p, f))) for f in folds])

    nothing = F.lit(None).cast("double")
    row = got.where("is_test = 0").agg(*[scorer(F.col("label"), unseen(p), nothing).alias(f"s{i}") for i, p in enumerate(params)]).first()
    best = params[int(np.argmax([row[i] if row[i] is not None else -np.inf for i in range(len(params))]))]
    return best, train_test_scores(got.select((F.col("is_test") == 1).alias("is_test"), "label", F.col(name(best)).alias("p")), metric)


def _search_knn(train: DataFrame, params: list[dict], classification: bool, scorer) -> dict:
    """All settings from one neighbour search per training set: rows keep their nearest of every fold."""
    k = max(p["k"] for p in params)
    q = train.select(F.lit(0).alias("gid"), "key", "x", F.col("fold").cast("double").alias("fold"), "label")
    base = train.select(F.lit(0).alias("gid"), "key", "x", F.col("fold").cast("int").alias("part"), F.array("label").alias("y"))
    lists = cut(nearest(q, base, k, carry=("fold", "label")), "knn_search")
    cols, aggs = [], []
    for i, p in enumerate(params):
        near = f"slice(filter(nn, n -> n.part != fold), 1, {p['k']})"
        cols.append((vote_of(near) if classification else mean_of(near, 0, p["weights"])).alias(f"p{i}"))
        votes = f"transform({near}, n -> named_struct('d', n.d, 'y', array(if(n.y[0] = label, 1D, 0D))))"
        cols.append(mean_of(votes, 0, p["weights"]).alias(f"q{i}"))
        aggs.append(scorer(F.col("label"), F.col(f"p{i}"), F.col(f"q{i}")).alias(f"s{i}"))
    row = lists.select("label", *cols).agg(*aggs).first()
    return params[int(np.argmax([row[i] if row[i] is not None else -np.inf for i in range(len(params))]))]


def default_scorer(classification: bool, classes: list[float] | None = None):
    """r2; f1 of label 1 where the labels are 0 and 1, else the mean f1 over the classes."""
    if not classification:
        return M.r2
    return M.f1 if classes is None or set(classes) <= {0.0, 1.0} else lambda y, p: M.f1_classes(y, p, classes)


def fit_base(rows: DataFrame, name: str, lim: Limits, classification: bool = False, scoring: str | None = None, metric=None) -> FittedModel:
    """Sample settings, cross-validate them on the hash folds, refit the best, score both sides."""
    train = rows.where(~F.col("is_test"))
    classes = label_classes(train) if classification else None
    metric = metric or default_scorer(classification, classes)
    scoring = scoring or ("log_loss" if classification else "r2")
    params = sample_params(name, lim)
    search = search_scorer(classification, scoring, classes)
    if name == "briskknn" and not classification:
        best, scores = _fit_knn(rows, params, search, metric)
        return FittedModel(name, best, classification, base=_knn_base(train), scores=scores)
    if name == "briskknn":
        # the probability of a label is its share of the votes
        best = _search_knn(train, params, classification, search)
        out = FittedModel(name, best, classification, base=_knn_base(train))
    elif name in BOOSTED:
        best = params[0] if len(params) == 1 else _search_boosted(train, params, classes, search)
        out = FittedModel(name, best, classification, _fit_boosted(train, best, classes))
    else:
        est = build_estimator(name, classification, lim.seed)
        best = params[0] if len(params) == 1 else _search_trees(est, train, params, classification, search, lim.parallelism)
        out = FittedModel(name, best, classification, est.fit(train, {est.getParam(k): v for k, v in best.items()}))
    out.scores = train_test_scores(out.predict(rows), metric)
    return out


def _fit_boosted(train: DataFrame, params: dict, classes: list[float] | None) -> Boosted:
    return fit_many(train, [(boosting_params(params, classes), None)], classes)[0]


def train_test_scores(predicted: DataFrame, metric, label: str = "label", p: str = "p") -> list[float]:
    """[train, test] score from one grouped aggregate."""
    got = {r["is_test"]: r["s"] for r in predicted.groupBy("is_test").agg(metric(F.col(label), F.col(p)).alias("s")).collect()}
    return [got.get(False), got.get(True)]


def select_models(models: list[FittedModel], threshold: float) -> list[FittedModel]:
    """Models whose test score reaches the threshold."""
    return [m for m in models if m.scores[1] is not None and m.scores[1] >= threshold]


@dataclass
class Stack:
    base: list[FittedModel]
    meta: FittedModel | None
    scores: list[float]

    def predict(self, rows: DataFrame, out: str = "p") -> DataFrame:
        if self.meta is None:
            return self.base[0].predict(rows, out)
        return self.meta.predict(stack_features(rows, self.base), out).select(*rows.columns, out)


def stack_features(rows: DataFrame, base: list[FittedModel]) -> DataFrame:
    """Base predictions side by side in place of the features; model transforms chain without a join."""
    out = rows
    for i, m in enumerate(base):
        out = m.predict(out, f"__b{i}")
    x = F.array(*[f"__b{i}" for i in range(len(base))])
    return out.withColumns({"x": x, "features": array_to_vector(x)}).drop(*[f"__b{i}" for i in range(len(base))])


def _refit(m: FittedModel, train: DataFrame, seed: int) -> FittedModel:
    if m.model is None:
        return FittedModel(m.name, m.params, m.classification, base=_knn_base(train))
    if isinstance(m.model, Boosted):
        return FittedModel(m.name, m.params, m.classification, _fit_boosted(train, m.params, None if m.model.classes is None else label_classes(train)))
    est = build_estimator(m.name, m.classification, seed)
    return FittedModel(m.name, m.params, m.classification, est.fit(train, {est.getParam(k): v for k, v in m.params.items()}))


def fit_stack(rows: DataFrame, base: list[FittedModel], lim: Limits, metric=None) -> Stack:
    """Bagged trees over the base predictions; a single base model passes through.

    The training predictions come from models that have not seen the row's fold, so that the upper model
    learns what the base models do on new rows.
    """
    if len(base) == 1:
        return Stack(base, None, base[0].scores)
    classification = base[0].classification
    train = rows.where(~F.col("is_test"))
    metric = metric or default_scorer(classification, label_classes(train) if classification else None)
    folds = [r[0] for r in train.select("fold").distinct().collect()]
    parts = None
    for f in sorted(folds):
        seen, held = train.where(F.col("fold") != f), train.where(F.col("fold") == f)
        part = stack_features(held, [_refit(m, seen, lim.seed) for m in base])
        parts = part if parts is None else parts.unionByName(part)
    meta_rows = cut(parts.unionByName(stack_features(rows.where("is_test"), base)), "stack")
    meta = fit_base(meta_rows, "briskbagging", lim, classification, metric=metric)
    return Stack(base, meta, meta.scores)


