"""The predictability task: scan of all column tuples, greedy selection, refinement of the best."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.metrics import SCORING
from ..operators import predict as P
from ..operators.clean import resolve_roles
from ..operators.combine import get_column_combinations, tuples_frame
from ..session import cut


@dataclass
class Predictability:
    tuples: DataFrame        # tuple_id, inputs, outputs
    metrics: DataFrame       # tuple_id, method, metric, value
    predictions: DataFrame   # tuple_id, key, is_test, fold, y{o}, linear{o}, power{o}, main{o}
    cv: DataFrame            # tuple_id, params, fold, test_score, train_score
    fits: DataFrame          # tuple_id and baseline coefficients
    method: str
    refined: "object | None" = None

    def wide(self) -> DataFrame:
        return P.wide_metrics(self.metrics, self.tuples, self.method)


def scan_tuples(df: DataFrame, pairs: P.Pairs, keys: list[str] | None = None, method: str = "kNN", scoring: str = "r2",
                scaling: str = "test", hidden_layers=None, alphas=None, seed: int = 1, with_dcor: bool = True,
                test_share: float = P.TEST_SHARE, rounds: int = 8) -> Predictability:
    """All tuples in the same jobs: moments, one neighbour search or training, one metric aggregate."""
    if method not in ("kNN", "MLP"):
        raise ValueError("method is kNN or MLP")
    if scoring not in SCORING:
        raise ValueError(f"unknown scoring {scoring!r}")
    spark = df.sparkSession
    cols = list(dict.fromkeys(c for a, b in pairs for c in (*a, *b)))
    n_in, n_out = len(pairs[0][0]), len(pairs[0][1])
    keyed = P.with_key(df, keys)
    names = [F.col(c).cast("double").alias(c) for c in cols]
    rows = P.split_rows(keyed, ["__key"], test_share, seed).select("__key", "is_test", "fold", *names)
    fits = P.fit_baselines(rows, cols, pairs)
    points = P.make_points(rows, cols, pairs)
    if method == "kNN":
        fitted = P.fit_knn(points, fits, n_in, n_out, scoring, scaling)
    else:
        fitted = P.fit_mlp(points, fits, n_in, n_out, scoring, scaling, hidden_layers, alphas, rounds, seed)
    table = cut(fitted.rows, "predictions")
    metrics = P.method_metrics(table, fits, n_out, method, with_dcor)
    return Predictability(tuples_frame(spark, pairs), metrics, table, fitted.cv, P.baseline_frame(spark, fits), method)


def best_per_target(metrics: DataFrame, tuples: DataFrame, method: str = "kNN", metric: str = "r2") -> DataFrame:
    """The best tuple of every target set, ties by tuple number."""
    r = metrics.where((F.col("method") == method) & (F.col("metric") == metric)).join(tuples, "tuple_id")
    w = W.partitionBy("outputs").orderBy(F.desc_nulls_last("value"), "tuple_id")
    return r.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def default_n_best(n: int) -> int:
    return min(max(math.floor(0.1 * n), 1), 20)


def tuple_selection(metrics: DataFrame, n_best: int | None = None, method: str | None = None) -> DataFrame:
    """The n best tuples by r2 of the main method; a tenth of them, 1 to 20, unless a number is given."""
    main = F.col("method").isin("kNN", "MLP") if method is None else F.col("method") == method
    r2 = metrics.where(main & (F.col("metric") == "r2"))
    n = n_best or default_n_best(r2.count())
    return r2.orderBy(F.desc_nulls_last("value"), "tuple_id").limit(n).select("tuple_id", F.col("value").alias("r2"))


def greedy_scan(df: DataFrame, pool: list[str], input_cols: int, target_sets, method: str = "kNN", **options) -> Predictability:
    """Grow the inputs of each target set one by one, each round keeping the best of that round.

    A round is one scan over the candidates of all target sets; the driver sees one row per target set.
    """
    chosen = {t: () for t in target_sets}
    all_pairs, parts = [], []
    for _ in range(input_cols):
        pairs = [((*ins, c), t) for t, ins in chosen.items() for c in pool if c not in ins and c not in t]
        if not pairs:
            break
        run = scan_tuples(df, pairs, method=method, **options)
        metrics = cut(run.metrics, "greedy")
        for r in best_per_target(metrics, run.tuples, method).collect():
            chosen[tuple(r["outputs"])] = tuple(r["inputs"])
        parts.append((run, metrics, len(all_pairs)))
        all_pairs += pairs
    shift = lambda d, off: d.withColumn("tuple_id", (F.col("tuple_id") + off).cast("int"))

    def stack(get):
        out = None
        for run, metrics, off in parts:
            d = shift(get(run, metrics), off)
            out = d if out is None else out.unionByName(d)
        return out

    return Predictability(stack(lambda r, m: r.tuples), stack(lambda r, m: m), stack(lambda r, m: r.predictions),
                          stack(lambda r, m: r.cv), stack(lambda r, m: r.fits), method)


def run_predictability(data: DataFrame, input_cols: int = 1, output_cols: int = 1, col_set=None, primkey_cols=None,
                       targets=None, method: str = "kNN", scoring: str = "r2", scaling: str = "test", hidden_layers=None,
                       alphas=None, max_iter: int = 160, greedy: bool = False, refined_n_best: int = 1, n_jobs: int = -1, verbose: int = 0,
                       random_state_split: int = 1, with_dcor: bool = True, refine_options: dict | None = None) -> Predictability:
    """How well each choice of input columns predicts each choice of target columns.

    ``max_iter`` bounds the passes of the networks over the training rows; they end earlier once no weight moves by the tolerance. ``n_jobs`` and ``verbose``
    are accepted and have no effect, as Spark schedules the work.
    """
    keys, targets = list(primkey_cols or []), list(targets or [])
    cols = resolve_roles(data, keys, col_set)
    # numbered once: scan, greedy rounds and refinement share one split
    data = cut(P.with_key(data, keys), "keyed")
    options = dict(keys=keys, scoring=scoring, scaling=scaling, hidden_layers=hidden_layers, alphas=alphas,
                   seed=random_state_split, with_dcor=with_dcor, rounds=max(1, math.ceil(max_iter / 20)))
    if greedy:
        _, sets = get_column_combinations(cols, 1, output_cols, targets, return_targets=True)
        pool = [c for c in cols if c not in targets]
        out = greedy_scan(data, pool, input_cols, sets, method=method, **options)
    else:
        out = scan_tuples(data, get_column_combinations(cols, input_cols, output_cols, targets), method=method, **options)
    if refined_n_best:
        out.refined = refine_predictability(data, out, refined_n_best, primkey_cols=keys, seed=random_state_split,
                                            **(refine_options or {}))
    return out


def refine_predictability(data: DataFrame, result: Predictability, n_best: int | None = None, primkey_cols=None,
                          seed: int = 1, **options):
    """Search model pipelines for the best tuples of a scan, on the same split."""
    from ..operators.refine import refine_tuples

    chosen = [r["tuple_id"] for r in tuple_selection(result.metrics, n_best, result.method).collect()]
    pairs = {r["tuple_id"]: (tuple(r["inputs"]), tuple(r["outputs"])) for r in
             result.tuples.where(F.col("tuple_id").isin(chosen)).collect()}
    return refine_tuples(data, [(t, *pairs[t]) for t in chosen], keys=list(primkey_cols or []), seed=seed, **options)


def compare_refined(initial: DataFrame, refined: DataFrame, method: str = "kNN") -> DataFrame:
    """Metrics of the first scan beside the refined ones, by tuple and metric."""
    a = initial.where(F.col("method") == method).select("tuple_id", "metric", F.col("value").alias("initial"))
    b = refined.select("tuple_id", "metric", F.col("value").alias("refined"))
    return a.join(b, ["tuple_id", "metric"], "left")


def predictability_plot(result: Predictability, tuple_id: int, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The tables behind the result plot of a tuple: residuals per method, and their histogram."""
    n_out = sum(c.startswith("main") for c in result.predictions.columns)
    rows = P.residuals(result.predictions.where(F.col("tuple_id") == tuple_id), n_out)
    return rows, P.error_histogram(rows, ["method", "output"], share)
