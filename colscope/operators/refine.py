"""Refinement: a seeded search over model pipelines, on the split of the first scan.

A pipeline is a preparation of the inputs and a regressor. Candidates are compared by the mean squared
error on hash folds; the winner is refitted on all training rows and measured on the test rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import MaxAbsScaler, MinMaxScaler, PolynomialExpansion, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions import metrics as M
from ..functions.keys import key_hash
from ..session import cut, dealt
from .boosting import Boosting, Reweighting, fit_adaboost, fit_extra_trees, fit_many
from .dcor import distance_correlation
from .matrix import map_rows
from .neighbors import best_of, distances, mean_of, nearest
from .predict import split_rows, with_key
from .quantiles import exact_quantiles
from .sgd import Descent, fit_descent

PREPARATIONS = ["none", "standard", "minmax", "maxabs", "robust", "poly2", "nystroem"]
# fixed values: what a drawn "nystroem" is made of
NYSTROEM = {"kernel": ["rbf", "cosine", "chi2", "laplacian", "polynomial", "linear", "additive_chi2", "sigmoid"], "components": range(1, 11), "gamma": [i / 20 for i in range(21)]}


def _choice(rng, options):
    return options[int(rng.integers(len(options)))]


def _trees(rng):
    return {"maxDepth": int(rng.integers(1, 11)), "minInstancesPerNode": int(rng.integers(1, 21))}


TREES = 100
DEALT = 10_000  # rows to a task of the fits, where there are twice as many
SHARES = [i / 20 for i in range(1, 21)]
RATES = [0.001, 0.01, 0.1, 0.5, 1.0]


def _leaves(rng):
    return {"min_rows": int(rng.integers(1, 21)), "min_split": int(rng.integers(2, 21))}


# regressor name -> draw of its settings; the ranges are fixed values
SPACE = {
    "elastic_net": lambda r: {"elasticNetParam": _choice(r, [i / 20 for i in range(21)]), "regParam": _choice(r, [0.0001, 0.001, 0.01, 0.1, 1.0])},
    "lasso": lambda r: {"regParam": _choice(r, [0.0001, 0.001, 0.01, 0.1, 1.0])},
    "ridge": lambda r: {"regParam": _choice(r, [0.1, 1.0, 10.0])},
    "sgd": lambda r: {"loss": _choice(r, ["squared", "huber", "epsilon_insensitive"]), "alpha": _choice(r, [0.0, 0.01, 0.001]), "schedule": _choice(r, ["invscaling", "constant"]), "intercept": _choice(r, [True, False]),
                      "l1_ratio": _choice(r, [0.25, 0.0, 1.0, 0.75, 0.5]), "eta0": _choice(r, [0.1, 1.0, 0.01]), "power_t": _choice(r, [0.5, 0.0, 1.0, 0.1, 100.0, 10.0, 50.0])},
    "huber": lambda r: {"regParam": _choice(r, [0.0, 0.01, 0.001]), "epsilon": _choice(r, [1.35, 2.0, 5.0])},
    "svr": lambda r: {"loss": _choice(r, ["epsilon_insensitive", "squared_epsilon_insensitive"]), "C": _choice(r, [1e-4, 1e-3, 1e-2, 1e-1, 0.5, 1.0, 5.0, 10.0, 15.0, 20.0, 25.0]), "epsilon": _choice(r, [1e-4, 1e-3, 1e-2, 1e-1, 1.0])},
    "boosting": lambda r: {**_leaves(r), "loss": _choice(r, ["squared", "absolute", "huber", "quantile"]), "rate": _choice(r, RATES), "max_depth": int(r.integers(1, 11)), "subsample": _choice(r, SHARES),
                           "columns": (1.0, 1.0, _choice(r, SHARES)), "alpha": _choice(r, [0.75, 0.8, 0.85, 0.9, 0.95, 0.99]), "rounds": TREES},
    "ada_boost": lambda r: {"rate": _choice(r, RATES), "loss": _choice(r, ["linear", "square", "exponential"]), "rounds": TREES},
    "extra_trees": lambda r: {**_leaves(r), "share": _choice(r, SHARES), "bootstrap": _choice(r, [True, False]), "trees": TREES},
    "random_forest": lambda r: {"minInstancesPerNode": int(r.integers(1, 21)), "maxDepth": 20, "featureSubsetStrategy": str(_choice(r, SHARES)), "bootstrap": _choice(r, [True, False]), "numTrees": TREES},
    "knn": lambda r: {"k": int(r.integers(1, 101)), "weights": _choice(r, ["uniform", "distance"]), "p": _choice(r, [1, 2])},
    "decision_tree": lambda r: {"maxDepth": int(r.integers(1, 11)), "minInstancesPerNode": int(r.integers(1, 21))},
    "xgb": lambda r: {"max_depth": int(r.integers(1, 11)), "rate": _choice(r, RATES), "subsample": _choice(r, SHARES), "min_weight": float(r.integers(1, 21)), "l2": 1.0, "rounds": TREES},
}

ESTIMATORS = {
    "elastic_net": LinearRegression, "lasso": lambda **p: LinearRegression(elasticNetParam=1.0, **p),
    "ridge": lambda **p: LinearRegression(elasticNetParam=0.0, **p), "huber": lambda **p: LinearRegression(loss="huber", **p),
    "random_forest": RandomForestRegressor, "decision_tree": DecisionTreeRegressor,
}
# ensembles of our own: several settings and folds grow together
OWN = {
    "boosting": lambda rows, ps: fit_many(rows, [(Boosting(**p), f) for p, f in ps]),
    "xgb": lambda rows, ps: fit_many(rows, [(Boosting(**p), f) for p, f in ps]),
    "ada_boost": lambda rows, ps: fit_adaboost(rows, [(Reweighting(**p), f) for p, f in ps]),
    "extra_trees": lambda rows, ps: [fit_extra_trees(rows, fold=f, **p) for p, f in ps],
}
# trees see the order of a column's values alone, which these keep
ORDERED = ("none", "standard", "minmax", "maxabs", "robust")


@dataclass
class Candidate:
    prep: str
    name: str
    params: dict

    def label(self) -> str:
        return f"{self.prep} > {self.name}({', '.join(f'{k}={v}' for k, v in sorted(self.params.items()))})"


def draw_candidates(n: int, seed: int = 1, space=None, preparations=None) -> list[Candidate]:
    space, preparations = space or SPACE, preparations or PREPARATIONS
    rng = np.random.default_rng(seed)
    names = list(space)
    # walk through the regressors so that a small budget still sees different ones
    order = [names[i] for i in rng.permutation(len(names))]
    def preparation() -> str:
        name = _choice(rng, preparations)
        return name if name != "nystroem" else f"nystroem:{_choice(rng, NYSTROEM['kernel'])}:{_choice(rng, NYSTROEM['components'])}:{_choice(rng, NYSTROEM['gamma'])}"

    return [Candidate(preparation(), order[i % len(order)], space[order[i % len(order)]](rng)) for i in range(n)]


def fit_preparation(name: str, train: DataFrame, components: int = 8, seed: int = 1):
    """A function from rows to rows that rewrites ``features`` and ``x``; fitted on the training rows."""
    def from_vector(model):
        def apply(rows):
            out = model.transform(rows).drop("features").withColumnRenamed("__f", "features")
            return out.withColumn("x", vector_to_array("features")).select(*rows.columns)
        return apply

    io = dict(inputCol="features", outputCol="__f")
    if name == "none":
        return lambda rows: rows
    if name == "poly2":
        return from_vector(PolynomialExpansion(degree=2, **io))
    if name.startswith("nystroem"):  # nystroem, or nystroem:kernel:components:gamma
        kind, *own = name.split(":")
        return fit_nystroem(train, int(own[1]), seed, own[0], float(own[2])) if own else fit_nystroem(train, components, seed)
    if name == "robust":
        return _robust(train)
    scaler = {"standard": lambda: StandardScaler(withMean=True, **io), "minmax": lambda: MinMaxScaler(**io),
              "maxabs": lambda: MaxAbsScaler(**io)}[name]()
    return from_vector(scaler.fit(train))


def _robust(train: DataFrame):
    """Median to 0 and interquartile range to 1, from exact quantiles; columns without a range are only moved."""
    d = len(train.select("x").head()["x"])
    marks = exact_quantiles(train.select(*[F.col("x")[i].alias(f"x{i}") for i in range(d)]), [f"x{i}" for i in range(d)], [0.25, 0.5, 0.75])
    at = [(q[1] or 0.0, (q[2] - q[0]) if q[0] is not None and q[2] > q[0] else 1.0) for q in (marks[f"x{i}"] for i in range(d))]

    def apply(rows):
        x = F.array(*[(F.col("x")[i] - F.lit(m)) / F.lit(w) for i, (m, w) in enumerate(at)])
        return rows.withColumn("x", x).withColumn("features", array_to_vector("x"))

    return apply


def _chi2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if (a < 0).any() or (b < 0).any():
        raise ValueError("the chi-squared kernels take no negative values")
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        both = a[:, j, None] + b[None, :, j]
        out += (a[:, j, None] - b[None, :, j]) ** 2 / np.where(both > 0, both, 1.0)
    return out


def _unit(a: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(axis=1, keepdims=True))
    return a / np.where(n > 0, n, 1.0)


# kernel name -> values between the rows of two blocks, for a width gamma
KERNELS = {
    "rbf": lambda a, b, g: np.exp(-g * distances(a, b) ** 2), "laplacian": lambda a, b, g: np.exp(-g * distances(a, b, 1)), "linear": lambda a, b, g: a @ b.T, "cosine": lambda a, b, g: _unit(a) @ _unit(b).T,
    "polynomial": lambda a, b, g: (g * (a @ b.T) + 1) ** 3, "sigmoid": lambda a, b, g: np.tanh(g * (a @ b.T) + 1), "chi2": lambda a, b, g: np.exp(-g * _chi2(a, b)), "additive_chi2": lambda a, b, g: -_chi2(a, b),
}


def fit_nystroem(train: DataFrame, components: int = 8, seed: int = 1, kernel: str = "rbf", gamma: float | None = None, scaled: bool = True):
    """Kernel features by a few landmark rows: k(x, L) K(L, L)^(-1/2). Inputs are divided by their deviations if ``scaled``; gamma is 1 / d by default."""
    marks = np.array([r["x"] for r in train.orderBy(key_hash("key", f"n{seed}")).limit(components).select("x").collect()])
    d = marks.shape[1]
    sd = np.array(train.agg(*[F.coalesce(F.stddev_pop(F.col("x")[i]), F.lit(0.0)) for i in range(d)]).first()) if scaled else np.ones(d)
    sd = np.where(sd > 0, sd, 1.0)
    width = 1 / d if gamma is None else gamma
    between = KERNELS[kernel]
    u, val, vt = np.linalg.svd(between(marks / sd, marks / sd, width))
    root = (u / np.sqrt(np.maximum(val, 1e-12))) @ vt

    def apply(rows):
        rest = [c for c in rows.columns if c not in ("x", "features")]
        out = map_rows(rows.select(*rest, "x"), lambda x: between(x / sd, marks / sd, width) @ root.T, "__y")
        return out.select(*rest, F.col("__y").alias("x"), array_to_vector("__y").alias("features")).select(*rows.columns)

    return apply


def fit_linear_svr(train: DataFrame, d: int, C: float = 1.0, epsilon: float = 0.01, rounds: int = 30, loss: str = "epsilon_insensitive"):
    """Epsilon-insensitive linear regression, plain or squared, by sub-gradient steps; each step is one aggregate of d + 1 sums."""
    stats = train.agg(F.avg("label"), F.stddev_pop("label"), *[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)], F.count("*")).first()
    my, sy, n = stats[0], stats[1] or 1.0, stats[-1]
    mx = np.array([stats[2 + 2 * i] for i in range(d)])
    sx = np.array([stats[3 + 2 * i] or 1.0 for i in range(d)])
    z = [(F.col("x")[i] - float(mx[i])) / float(sx[i]) for i in range(d)]
    w, b = np.zeros(d), 0.0
    mean_w, mean_b = w.copy(), 0.0
    for t in range(rounds):
        guess = sum((z[i] * float(w[i]) for i in range(d)), F.lit(float(b)))
        miss = (F.col("label") - my) / sy - guess
        side = F.when(miss > epsilon, -1.0).when(miss < -epsilon, 1.0).otherwise(0.0)
        if loss == "squared_epsilon_insensitive":
            side = side * F.greatest(F.abs(miss) - epsilon, F.lit(0.0))
        g = np.array(train.agg(*[F.sum(side * z[i]) for i in range(d)], F.sum(side)).first(), dtype=float)
        rate = 0.5 / np.sqrt(t + 1)
        w = w - rate * (w / (C * n) + g[:-1] / n)
        b -= rate * g[-1] / n
        mean_w, mean_b = mean_w + (w - mean_w) / (t + 1), mean_b + (b - mean_b) / (t + 1)
    coef = mean_w * sy / sx
    return my + mean_b * sy - float(coef @ mx), coef


def fit_candidate(c: Candidate, train: DataFrame, seed: int = 1):
    """A function that adds the prediction ``p`` to rows."""
    prep = fit_preparation(c.prep, train, seed=seed)
    rows = prep(train)
    if c.name == "knn":
        base = rows.select(F.lit(0).alias("gid"), "key", "x", F.lit(0).alias("part"), F.array("label").alias("y"))

        def predict(new):
            q = prep(new)
            nn = nearest(q.select(F.lit(0).alias("gid"), "key", "x"), base, c.params["k"], p=c.params["p"])
            return new.join(nn.select("key", mean_of(best_of("nn", c.params["k"]), 0, c.params["weights"]).alias("p")), "key")
        return predict
    if c.name in OWN:
        return _with(OWN[c.name](rows, [(c.params, None)])[0].predict, prep)
    if c.name == "sgd":
        b, w = fit_descent(rows, Descent(seed=seed, **c.params))
        return _with(lambda x: b + x @ w, prep)
    if c.name == "svr":
        d = rows.select(F.size("x")).first()[0]
        b, w = fit_linear_svr(cut(rows.select("x", "label"), "svr"), d, c.params["C"], c.params["epsilon"], loss=c.params.get("loss", "epsilon_insensitive"))
        value = sum((F.col("x")[i] * float(w[i]) for i in range(d)), F.lit(float(b)))
        return lambda new: new.join(prep(new).select("key", value.alias("p")), "key") if c.prep != "none" else new.withColumn("p", value)
    model = ESTIMATORS[c.name](**c.params).fit(rows)
    # transforms chain on the row, so the prediction needs no join
    return lambda new: model.transform(prep(new)).select(*[x for x in new.columns if x not in ("x", "features")], F.col("prediction").alias("p"))


def _with(predict, prep):
    """Adds the value of a function of the prepared inputs to rows, on the row itself."""
    def apply(new: DataFrame) -> DataFrame:
        out = [x for x in new.columns if x not in ("x", "features")]
        return map_rows(prep(new).select(*out, "x"), lambda x: predict(x)[:, None], "__p").select(*out, F.col("__p")[0].alias("p"))
    return apply


def _own_errors(candidates: list[Candidate], train: DataFrame, folds: int) -> list[float]:
    """Errors of ensembles that grow side by side for all settings and folds; every row is met by the models that have not seen its fold, in one pass."""
    fits = [(c.params, f) for c in candidates for f in range(folds)]
    models = OWN[candidates[0].name](train, fits)

    def predict(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(candidates)))
        for f in range(folds):
            mine = np.flatnonzero(x[:, 0] == f)
            if len(mine):
                for i in range(len(candidates)):
                    out[mine, i] = models[i * folds + f].predict(x[mine, 1:])
        return out

    got = map_rows(train.select("label", F.concat(F.array(F.col("fold").cast("double")), "x").alias("x")), predict, "__p")
    return list(got.agg(*[F.avg((F.col("label") - F.col("__p")[i]) ** 2) for i in range(len(candidates))]).first())


def candidate_errors(candidates: list[Candidate], train: DataFrame, folds: int = 3, seed: int = 1) -> list[float]:
    """Cross-validated mean squared error; a candidate that cannot be fitted counts as infinitely bad."""
    together: dict[tuple, list[int]] = {}
    for i, c in enumerate(candidates):
        if c.name in OWN and (c.prep in ORDERED or c.prep == "poly2"):
            together.setdefault((c.name, c.prep == "poly2"), []).append(i)
    known: dict[int, float] = {}
    for (_, poly), own in together.items():
        rows = cut(fit_preparation("poly2", train)(train), "poly2") if poly else train
        known |= {i: float("inf") if e is None or np.isnan(e) else e for i, e in zip(own, _own_errors([candidates[i] for i in own], rows, folds))}
    out = []
    for i, c in enumerate(candidates):
        if i in known:
            out.append(known[i])
            continue
        total, n = 0.0, 0
        try:
            for f in range(folds):
                held = train.where(F.col("fold") == f)
                got = fit_candidate(c, train.where(F.col("fold") != f), seed)(held)
                s, k = got.agg(F.sum((F.col("label") - F.col("p")) ** 2), F.count("p")).first()
                total, n = total + (s or 0.0), n + k
            out.append(total / n if n else float("inf"))
        except (ValueError, ArithmeticError, np.linalg.LinAlgError):
            out.append(float("inf"))
    return out


@dataclass
class Refined:
    metrics: DataFrame      # tuple_id, metric, value
    predictions: DataFrame  # tuple_id, output, key, y, p
    trials: DataFrame       # tuple_id, output, pipeline, mse


def refine_tuples(df: DataFrame, tuples: list[tuple], keys: list[str], n_trials: int = 12, seed: int = 1, space=None,
                  preparations=None, test_share: float = 0.3) -> Refined:
    """Search pipelines for each ``(tuple_id, inputs, outputs)``; several outputs are fitted one by one."""
    spark = df.sparkSession
    keyed = split_rows(with_key(df, keys), ["__key"], test_share, seed)
    candidates = draw_candidates(n_trials, seed, space, preparations)
    preds, trials = None, []
    for tid, ins, outs in tuples:
        x = F.array(*[F.col(c).cast("double") for c in ins])
        for o, name in enumerate(outs):
            rows = cut(keyed.dropna("any", subset=[*ins, *outs]).select(
                F.col("__key").alias("key"), "is_test", "fold", F.col(name).cast("double").alias("label"), x.alias("x"),
                array_to_vector(x).alias("features")), "refine")
            rows = dealt(rows, "key", DEALT, "refine")
            train = rows.where(~F.col("is_test"))
            errors = candidate_errors(candidates, train, seed=seed)
            trials += [(tid, o, c.label(), float(e)) for c, e in zip(candidates, errors)]
            best = candidates[int(np.argmin(errors))]
            got = fit_candidate(best, train, seed)(rows.where("is_test"))
            part = cut(got.select(F.lit(tid).alias("tuple_id"), F.lit(o).alias("output"), "key", F.col("label").alias("y"), "p"), "refined")
            preds = part if preds is None else preds.unionByName(part)
    per = M.regression_metrics(preds, ["tuple_id", "output"])
    names = ["r2", "RMSE", "MAPE", "rae"]
    d = distance_correlation(preds.select((F.col("tuple_id") * 64 + F.col("output")).cast("int").alias("gid"), "key", F.col("y").alias("x"), F.col("p").alias("y")))
    d = d.select(F.floor(F.col("gid") / 64).cast("int").alias("tuple_id"), F.pmod("gid", F.lit(64)).alias("output"), "dcor")
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in [*names, "dcor"]])
    metrics = (per.join(d, ["tuple_id", "output"]).select("tuple_id", F.inline(cells)).groupBy("tuple_id", "metric").agg(F.avg("value").alias("value")))
    return Refined(metrics, preds, spark.createDataFrame(trials, "tuple_id int, output int, pipeline string, mse double"))
