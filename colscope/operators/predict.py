"""Predictability of many column tuples at once: split, baselines, kNN or networks, metrics.

A *point* is a row seen through a tuple: ``tuple_id, key, is_test, fold, x ARRAY, y ARRAY``. Points are
only made where row-level work needs them; the baselines come from shared moments.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import metrics as M
from ..functions.keys import fold, is_test
from ..session import cut
from . import gram, mlp
from .dcor import distance_correlation, distance_correlation_blocks
from .neighbors import Means, nearest
from .order import with_position

# fixed values
K_LIST = [3, 8, 15]
FOLDS = 3
TEST_SHARE = 0.3
METRIC_NAMES = ["r2", "RMSE", "RMSE/std", "MAPE", "rae", "dcor"]
BROADCAST_TUPLES = 20_000
PREDICTED = 50_000  # rows that a task takes through the networks, however the input's files are cut

Pairs = list[tuple[tuple[str, ...], tuple[str, ...]]]


def with_key(df: DataFrame, keys: list[str] | None) -> DataFrame:
    """Give each row a unique ``__key BIGINT``: a single integer key column that has each value once, or a position in key order.

    Rows that have a ``__key`` already keep it, so that a caller can number them once for several steps.
    """
    if "__key" in df.columns:
        return df
    if keys and len(keys) == 1 and dict(df.dtypes)[keys[0]] in ("bigint", "int", "smallint", "tinyint"):
        counted = df.groupBy(F.col(keys[0]).alias("k")).count()
        if counted.filter("k IS NULL OR count > 1").isEmpty():
            return df.withColumn("__key", F.col(keys[0]).cast("long"))
    if keys:
        return with_position(df, list(keys), "__key")
    # no key: number the rows once and store them, since such numbers change when recomputed
    return cut(df.withColumn("__key", F.monotonically_increasing_id()), "keyed")


def split_rows(df: DataFrame, keys: list[str], test_share: float = TEST_SHARE, seed: int = 1, folds: int = FOLDS) -> DataFrame:
    """Add ``is_test`` and ``fold``; both depend on the key text and seed only."""
    return df.withColumns({"is_test": is_test(keys, test_share, seed), "fold": fold(keys, folds, seed)})


@dataclass
class Baseline:
    """What the moments say about one tuple."""

    tuple_id: int
    n_train: int
    n_test: int
    mean: list[float]
    y_test_mean: list[float]
    linear: list[list[float]] | None
    power: list[list[float]] | None
    scaling: dict[int, tuple[list[float], list[float]]]  # left-out fold (-1: none) -> means, deviations of x


def fit_baselines(rows: DataFrame, cols: list[str], pairs: Pairs) -> list[Baseline]:
    """Mean, linear and power-law fits of all tuples from one pass for the centres and one for the sums."""
    group = F.when(F.col("is_test"), "t").otherwise(F.col("fold").cast("string"))
    shifts = gram.column_means(rows, cols, log=True)
    at = {c: i for i, c in enumerate(cols)}
    sums = gram.accumulate(rows, cols, shifts, group, [[at[c] for c in (*a, *b)] for a, b in pairs])
    raw, logs, shift, lshift = sums["raw"], sums["log"], shifts["raw"], shifts["log"]

    def gather(sums, without=None):
        return [p for g, p in sums.items() if g != "t" and g != str(without)]

    out = []
    for tid, (ins, outs) in enumerate(pairs):
        pick = [at[c] for c in (*ins, *outs)]
        xi, yi = list(range(len(ins))), list(range(len(ins), len(pick)))
        train, low = gram.moments(gather(raw), shift, pick, tid)
        test, low_test = gram.moments([raw.get("t", {})], shift, pick, tid)
        lin = gram.solve(train, xi, yi)
        power = None
        if train.n and min(low.min(), low_test.min()) > 0:
            power = gram.solve(gram.moments(gather(logs), lshift, pick, tid)[0], xi, yi)
        scaling = {}
        for f in (-1, *range(FOLDS)):
            m = gram.moments(gather(raw, f), shift, pick, tid)[0]
            sd = np.sqrt(np.diag(m.scatter) / max(m.n, 1))
            scaling[f] = (m.mean[xi].tolist(), np.where(sd > 0, sd, 1.0)[xi].tolist())
        lists = lambda c: None if c is None else c.T.tolist()
        out.append(Baseline(tid, int(train.n), int(test.n), train.mean[yi].tolist(), test.mean[yi].tolist(),
                            lists(lin), lists(power), scaling))
    return out


def baseline_frame(spark: SparkSession, fits: list[Baseline]) -> DataFrame:
    return spark.createDataFrame(
        [(b.tuple_id, b.n_train, b.n_test, b.mean, b.y_test_mean, b.linear, b.power) for b in fits],
        "tuple_id int, n_train bigint, n_test bigint, mean array<double>, y_test_mean array<double>, "
        "linear array<array<double>>, power array<array<double>>")


def make_points(rows: DataFrame, cols: list[str], pairs: Pairs) -> DataFrame:
    """Every row once per tuple it is complete in; an equi-join with the small tuple table."""
    spark = rows.sparkSession
    at = {c: i for i, c in enumerate(cols)}
    tuples = spark.createDataFrame([(i, [at[c] for c in a], [at[c] for c in b]) for i, (a, b) in enumerate(pairs)],
                                   "tuple_id int, xi array<int>, yi array<int>")
    if len(pairs) <= BROADCAST_TUPLES:
        tuples = F.broadcast(tuples)
    vals = F.array(*[F.col(c).cast("double") for c in cols])
    wide = rows.select(F.col("__key").alias("key"), "is_test", "fold", vals.alias("v"),
                       F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("tuple_id"))
    pick = lambda ix: F.transform(F.col(ix), lambda i: F.col("v")[i])
    pts = wide.join(tuples, "tuple_id").select("tuple_id", "key", "is_test", "fold", pick("xi").alias("x"), pick("yi").alias("y"))
    gone = lambda a: F.exists(a, lambda v: v.isNull() | F.isnan(v))
    return pts.where(~gone("x") & ~gone("y"))


def linear_value(coef: Column, x: Column) -> Column:
    """Intercept plus weighted sum, from ``[intercept, w1, ..]``."""
    terms = F.zip_with(F.slice(coef, 2, F.size(x)), x, lambda a, b: a * b)
    return F.aggregate(terms, coef[0], lambda s, t: s + t)


def baseline_predictions(points: DataFrame, fits: list[Baseline], n_out: int) -> DataFrame:
    """Points with ``linear{o}`` and ``power{o}`` columns; null where there is no such fit."""
    spark = points.sparkSession
    coefs = baseline_frame(spark, fits).select("tuple_id", "linear", "power")
    if len(fits) <= BROADCAST_TUPLES:
        coefs = F.broadcast(coefs)
    logs = F.transform("x", lambda v: F.ln(v))
    out = points.join(coefs, "tuple_id")
    for o in range(n_out):
        out = out.withColumns({
            f"linear{o}": F.when(F.col("linear").isNotNull(), linear_value(F.col("linear")[o], F.col("x"))),
            f"power{o}": F.when(F.col("power").isNotNull(), F.exp(linear_value(F.col("power")[o], logs)))})
    return out.drop("linear", "power")


@dataclass
class Fitted:
    """Row-level predictions of the main method and its cross-validation table."""

    rows: DataFrame   # tuple_id, key, is_test, fold, y{o}, linear{o}, power{o}, main{o}
    cv: DataFrame     # tuple_id, params MAP, fold, test_score, train_score


def _cv_scores(means: DataFrame, n_out: int, scoring: str, fold_of: int | None) -> DataFrame:
    """Scores per gid, k and fold from the means of neighbour lists, all from one aggregate.

    With ``fold_of`` None a list holds neighbours of every fold and there is a mean for each fold left out; otherwise the
    searches left out that fold already.
    """
    folds = list(range(FOLDS)) if fold_of is None else [fold_of]
    aggs = []
    for k in K_LIST:
        for f in folds:
            for side, on in (("test", F.col("fold") == f), ("train", F.col("fold") != f)):
                p = [F.col(f"m{k}_{f}_{o}" if fold_of is None else f"m{k}_{o}") for o in range(n_out)]
                parts = [M.score(scoring, F.when(on, F.col(f"y{o}")), p[o]) for o in range(n_out)]
                aggs.append((sum(parts[1:], parts[0]) / n_out).alias(f"{side}_{k}_{f}"))
    rows = [F.struct(F.lit(k).alias("k"), F.lit(f).alias("fold"), F.col(f"test_{k}_{f}").alias("test_score"),
                     F.col(f"train_{k}_{f}").alias("train_score")) for k in K_LIST for f in folds]
    return means.where("is_test = 0").groupBy("gid").agg(*aggs).select("gid", F.inline(F.array(*rows)))


def fit_knn(points: DataFrame, fits: list[Baseline], n_in: int, n_out: int, scoring: str = "r2", scaling: str = "test") -> Fitted:
    """Grid search over k and scaling with three folds, and the predictions of the best setting.

    Unscaled, one neighbour search per tuple serves all k, all folds and the final fit: each row keeps
    its nearest rows of every fold. Scaled inputs have other statistics per fold, hence a search each;
    with a single input scaling cannot change the order of distances, so nothing is searched again.
    """
    spark = points.sparkSession
    slots = 2 + FOLDS
    gid = lambda code: (F.col("tuple_id") * slots + code).cast("int")
    ys = [f"y{o}" for o in range(n_out)]
    carry = ("fold", "is_test", *ys, *[f"{m}{o}" for m in ("linear", "power") for o in range(n_out)])
    pts = baseline_predictions(points, fits, n_out)
    pts = pts.select("tuple_id", "key", F.col("fold").cast("double"), F.col("is_test").cast("double"), "x", "y",
                     *[F.col("y")[o].alias(f"y{o}") for o in range(n_out)],
                     *[f"{m}{o}" for m in ("linear", "power") for o in range(n_out)])
    pts = cut(pts, "points")
    plain = scaling in ("no", "test") or n_in == 1
    scaled = scaling in ("yes", "test") and n_in > 1
    queries, bases = [], []
    if plain:
        queries.append(pts.withColumn("gid", gid(0)))
        bases.append(pts.where("is_test = 0").withColumn("gid", gid(0)).withColumn("part", F.col("fold").cast("int")))
    if scaled:
        stats = spark.createDataFrame([(b.tuple_id, f, *b.scaling[f]) for b in fits for f in b.scaling],
                                      "tuple_id int, left_out int, m array<double>, s array<double>")
        # a row takes part in the final fit and in each fold's; scaled by that fit's training rows
        moved = pts.join(stats, "tuple_id").withColumn("x", F.zip_with(
            F.zip_with("x", "m", lambda a, b: a - b), "s", lambda a, b: a / b)).withColumn("gid", gid(F.col("left_out") + 2))
        queries.append(moved.where((F.col("left_out") < 0) | (F.col("is_test") == 0)))
        bases.append(moved.where((F.col("is_test") == 0) & (F.col("fold") != F.col("left_out"))).withColumn("part", F.lit(0)))
    pick = lambda dfs, cols: [d.select(*cols) for d in dfs]
    q = pick(queries, ["gid", "key", "x", *carry])
    b = pick(bases, ["gid", "key", "x", "part", "y"])
    for d in q[1:]:
        q[0] = q[0].unionByName(d)
    for d in b[1:]:
        b[0] = b[0].unionByName(d)
    wanted = Means(K_LIST, list(range(FOLDS)), n_out)
    lists = cut(nearest(q[0], b[0], max(K_LIST), carry=carry, dims=(n_in, n_out), stored=True, means=wanted), "neighbours")
    code = F.pmod("gid", F.lit(slots))
    tuple_of = F.floor(F.col("gid") / slots).cast("int").alias("tuple_id")
    cv = None

    def add(part):
        nonlocal cv
        cv = part if cv is None else cv.unionByName(part)

    if plain:
        base_cv = _cv_scores(lists.where(code == 0), n_out, scoring, None).select(tuple_of, "k", "fold", "test_score", "train_score")
        for s in ([False] if scaling == "no" else [True] if scaling == "yes" else [False, True] if n_in == 1 else [False]):
            add(base_cv.withColumn("scaled", F.lit(s)))
    if scaled:
        for f in range(FOLDS):
            add(_cv_scores(lists.where(code == f + 2), n_out, scoring, f)
                .select(tuple_of, "k", "fold", "test_score", "train_score", F.lit(True).alias("scaled")))
    cv = cut(cv, "cv")
    # best mean score; ties go to the setting without scaling, then to the smaller k
    mean = cv.groupBy("tuple_id", "scaled", "k").agg(F.avg("test_score").alias("score"))
    best = mean.groupBy("tuple_id").agg(F.max_by(F.struct("scaled", "k"), F.struct(
        F.coalesce("score", F.lit(float("-inf"))), (~F.col("scaled")).alias("u"), (-F.col("k")).alias("nk"))).alias("b"))
    best = best.select("tuple_id", F.col("b.scaled").alias("use_scaled"), F.col("b.k").alias("use_k"))
    final = lists.where(code < 2).withColumn("tuple_id", tuple_of).join(best, "tuple_id")
    if scaled and plain:
        final = final.where((code == 1) == F.col("use_scaled"))
    main = []
    for o in range(n_out):
        p = F.lit(None).cast("double")
        for k in K_LIST:
            p = F.when(F.col("use_k") == k, F.col(f"m{k}_{o}")).otherwise(p)
        main.append(p.alias(f"main{o}"))
    rows = final.select("tuple_id", "key", (F.col("is_test") == 1).alias("is_test"), F.col("fold").cast("int"), *ys,
                        *[f"{m}{o}" for m in ("linear", "power") for o in range(n_out)], *main)
    params = F.create_map(F.lit("n_neighbors"), F.col("k").cast("string"), F.lit("scaler"), F.col("scaled").cast("string"))
    return Fitted(rows, cv.select("tuple_id", params.alias("params"), "fold", "test_score", "train_score"))


def fit_mlp(points: DataFrame, fits: list[Baseline], n_in: int, n_out: int, scoring: str = "r2", scaling: str = "test",
            hidden=None, alphas=None, rounds: int = 8, seed: int = 1) -> Fitted:
    """Grid search over layers, penalties and scaling with three folds; all networks learn in the same rounds."""
    hidden, alphas = hidden or mlp.HIDDEN, alphas or mlp.ALPHAS
    grid = [(s, h, a) for s in {"no": [False], "yes": [True]}.get(scaling, [False, True]) for h in hidden for a in alphas]
    pts = baseline_predictions(points, fits, n_out).withColumn("gid", F.col("tuple_id"))
    shares = sum(b.n_train + b.n_test for b in fits) // PREDICTED
    pts = cut(pts.repartition(shares, "tuple_id", "key") if shares > 1 else pts, "points")
    train_rows = pts.where(~F.col("is_test"))
    ysd = {r["tuple_id"]: [r[f"s{o}"] or 1.0 for o in range(n_out)] for r in train_rows.groupBy("tuple_id").agg(
        *[F.stddev_pop(F.col("y")[o]).alias(f"s{o}") for o in range(n_out)]).collect()}

    def net(i, b, setting, skip):
        s, h, a = setting
        m, sd = b.scaling[skip] if s else ([0.0] * n_in, [1.0] * n_in)
        sizes = [n_in, *h, n_out]
        return mlp.Net(i, b.tuple_id, skip, sizes, a, np.array(m), np.array(sd), np.array(b.mean),
                       np.array(ysd[b.tuple_id]), mlp.start(sizes, seed))

    able = [b for b in fits if b.tuple_id in ysd]
    jobs = [(b, g, f) for b in able for g in range(len(grid)) for f in range(FOLDS)]
    nets = mlp.train(train_rows, [net(i, b, grid[g], f) for i, (b, g, f) in enumerate(jobs)], rounds, seed=seed)
    # networks are numbered by tuple, setting and fold; a join would send every prediction of a network to one task
    number = F.col("net_id")
    scored = mlp.predict(train_rows, nets, ["tuple_id", "fold", "y"]).withColumns({"g": F.floor(number / FOLDS).cast("int") % len(grid), "net_fold": number % FOLDS})

    def sc(on):
        parts = [M.score(scoring, F.when(on, F.col("y")[o]), F.col("p")[o]) for o in range(n_out)]
        return sum(parts[1:], parts[0]) / n_out

    held = F.col("fold") == F.col("net_fold")
    cv = cut(scored.groupBy("tuple_id", "g", "net_fold").agg(sc(held).alias("test_score"), sc(~held).alias("train_score")), "cv")
    best = {r["tuple_id"]: -r["b"]["ng"] for r in cv.groupBy("tuple_id", "g").agg(F.avg("test_score").alias("s")).groupBy("tuple_id").agg(
        F.max(F.struct(F.coalesce("s", F.lit(float("-inf"))).alias("s"), (-F.col("g")).alias("ng"))).alias("b")).collect()}
    finals = mlp.train(train_rows, [net(b.tuple_id, b, grid[best[b.tuple_id]], -1) for b in able], rounds, seed=seed)
    keep = ["tuple_id", "key", "is_test", "fold", "y", *[f"{m}{o}" for m in ("linear", "power") for o in range(n_out)]]
    rows = mlp.predict(pts, finals, keep).select(
        "tuple_id", "key", "is_test", F.col("fold").cast("int"), *[F.col("y")[o].alias(f"y{o}") for o in range(n_out)],
        *keep[5:], *[F.col("p")[o].alias(f"main{o}") for o in range(n_out)])
    names = F.array(*[F.create_map(F.lit("hidden_layer_sizes"), F.lit("-".join(map(str, h))), F.lit("alpha"), F.lit(str(a)),
                                   F.lit("scaler"), F.lit(str(s).lower())) for s, h, a in grid])
    return Fitted(rows, cv.select("tuple_id", names[F.col("g")].alias("params"), F.col("net_fold").alias("fold"), "test_score", "train_score"))


def method_metrics(rows: DataFrame, fits: list[Baseline], n_out: int, main: str, with_dcor: bool = True) -> DataFrame:
    """Long table ``tuple_id, method, metric, value`` of the test rows.

    One aggregate per output gives all methods side by side; only its few rows are turned.
    """
    spark = rows.sparkSession
    small = baseline_frame(spark, fits).select("tuple_id", "mean", "y_test_mean")
    test = rows.where("is_test").join(F.broadcast(small) if len(fits) <= BROADCAST_TUPLES else small, "tuple_id")
    methods = {main: "main", "linear": "linear", "mean": "mean", "pow. law": "power"}
    centre = F.aggregate("y_test_mean", F.lit(0.0), lambda a, v: a + v) / F.size("y_test_mean")
    aggs = []
    for name, c in methods.items():
        preds = [F.col("mean")[o] if c == "mean" else F.col(f"{c}{o}") for o in range(n_out)]
        for metric, fn in M.METRICS.items():
            if metric != "MAE":
                parts = [fn(F.col(f"y{o}"), preds[o]) for o in range(n_out)]
                aggs.append((sum(parts[1:], parts[0]) / n_out).alias(f"{name}|{metric}"))
        err = sum((F.sum(F.abs(preds[o] - F.col(f"y{o}"))) for o in range(n_out)), F.lit(0.0))
        ref = sum((F.sum(F.when(preds[o].isNotNull(), F.abs(centre - F.col(f"y{o}")))) for o in range(n_out)), F.lit(0.0))
        aggs.append((err / ref).alias(f"{name}|rae"))
    flat = test.groupBy("tuple_id").agg(*aggs)
    cells = [F.struct(F.lit(n).alias("method"), F.lit(m).alias("metric"), F.col(f"`{n}|{m}`").alias("value"))
             for n in methods for m in METRIC_NAMES if m != "dcor"]
    long = flat.select("tuple_id", F.inline(F.array(*cells)))
    if not with_dcor:
        return long
    order = list(methods.items())
    gid = lambda i: (F.col("tuple_id") * len(order) + i).cast("int").alias("gid")
    wanted = [(i, c) for i, (_, c) in enumerate(order) if c != "mean"]
    if n_out == 1:
        turned = F.array(*[F.struct(gid(i), F.col(f"{c}0").alias("x")) for i, c in wanted])
        d = distance_correlation(test.select("key", F.col("y0").alias("y"), F.inline(turned)), stored=True)
    else:
        turned = F.array(*[F.struct(gid(i), F.array(*[F.col(f"{c}{o}") for o in range(n_out)]).alias("x")) for i, c in wanted])
        d = test.select("key", F.array(*[f"y{o}" for o in range(n_out)]).alias("y"), F.inline(turned))
        d = distance_correlation_blocks(d.where(F.col("x")[0].isNotNull()))
    names = F.array(*[F.lit(n) for n, _ in order])
    dc = d.select(F.floor(F.col("gid") / len(order)).cast("int").alias("tuple_id"),
                  names[F.pmod("gid", F.lit(len(order)))].alias("method"), F.lit("dcor").alias("metric"), F.col("dcor").alias("value"))
    # a constant prediction has no distances: 0 by definition
    flat0 = flat.select("tuple_id", F.lit("mean").alias("method"), F.lit("dcor").alias("metric"), F.lit(0.0).alias("value"))
    return long.unionByName(dc).unionByName(flat0)


def wide_metrics(long: DataFrame, tuples: DataFrame, main: str) -> DataFrame:
    """One row per tuple, a column per method and metric."""
    names = [f"{m} {x}" for m in (main, "linear", "mean", "pow. law") for x in METRIC_NAMES]
    return (long.withColumn("label", F.concat_ws(" ", "method", "metric")).groupBy("tuple_id").pivot("label", names)
            .agg(F.first("value")).join(tuples, "tuple_id"))


def residuals(rows: DataFrame, outputs: int = 1, columns=("main", "linear", "power")) -> DataFrame:
    """Truth, prediction and error of the test rows per method."""
    cells = [F.struct(F.lit(c).alias("method"), F.lit(o).alias("output"), F.col(f"y{o}").alias("true"), F.col(f"{c}{o}").alias("pred"))
             for c in columns for o in range(outputs)]
    return (rows.where("is_test").select("tuple_id", "key", F.inline(F.array(*cells))).where(F.col("pred").isNotNull())
            .withColumn("error", F.col("pred") - F.col("true")))


def error_histogram(errors: DataFrame, by: list[str], share: float = 0.1) -> DataFrame:
    """Equal-width counts of the errors in ``floor(n * share)`` bins per group."""
    ends = errors.groupBy(*by).agg(F.min("error").alias("lo"), F.max("error").alias("hi"),
                                   F.greatest(F.floor(F.count("*") * share), F.lit(1)).cast("int").alias("bins"))
    pos = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(
        F.floor((F.col("error") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))) + 1, F.col("bins")))
    return errors.join(ends, by).groupBy(*by, pos.cast("int").alias("bin")).agg(F.count("*").alias("n"))
