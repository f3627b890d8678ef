"""The complexity task: the smallest dimension in which the order of distances survives."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import linear_dim as L, nonlinear_dim as N
from ..operators.clean import bad_columns, exclude_names, project, reduce_rows
from ..operators.matrix import as_matrix, matrix_moments, standardize_matrix, width
from ..operators.predict import with_key
from ..operators.profile import numeric_columns
from ..operators.quality import AROUND, measured_quality, quality_from_sums, rank_sums, sample_pairs
from ..session import cut

NUMERIC = ("LinAlgError", "ValueError", "FloatingPointError", "ZeroDivisionError", "OverflowError")


@dataclass
class Method:
    """An embedding: ``fit(matrix, k, **params)`` returns ``key, x, y``. Ranges are (kind, low, high)."""

    fit: Callable[..., DataFrame]
    ranges: dict[str, tuple] = field(default_factory=dict)


def _linear(fn):
    return lambda m, k, **p: fn(m, k, **p).transform(m)


def _batched(m: DataFrame, k: int, batches: int = 4) -> DataFrame:
    lot = F.pmod(F.xxhash64(F.lit(41), "key"), F.lit(batches))
    return L.incremental_pca((m.where(lot == b) for b in range(batches)), k).transform(m)


# registered names are fixed values; callers may add their own methods
METHODS: dict[str, Method] = {
    "py_pca": Method(_linear(L.pca)),
    "py_pca_sparse": Method(_linear(L.sparse_pca), {"alpha": ("log", 1e-4, 0.1), "ridge": ("log", 0.1, 10.0)}),
    "py_pca_incremental": Method(_batched, {"batches": ("int", 2, 8)}),
    "py_truncated_svd": Method(_linear(L.truncated_svd)),
    "py_crca": Method(N.curvilinear, {"alpha": ("log", 0.05, 1.0), "lmbda": ("log", 0.5, 20.0)}),
    "py_sammon": Method(N.sammon, {"max_iter": ("int", 5, 20)}),
    "r_adr": Method(_linear(L.adaptive_reduction), {"maxiter": ("int", 2, 100), "abstol": ("log", 0.01, 0.2)}),
    "r_mds": Method(_linear(L.classical_scaling)),
    "r_ppca": Method(_linear(L.probabilistic_pca)),
    "r_rpcag": Method(_linear(L.robust_pca), {"subsets": ("int", 2, 50)}),
    "r_ispe": Method(N.proximity, {"updates": ("int", 1, 100), "drate": ("real", 0.01, 0.999)}),
}


def draw_params(ranges: dict[str, tuple], rng: np.random.Generator, around: dict | None = None) -> dict:
    """Uniform, log-uniform or whole-number draws; near the given point if there is one."""
    out = {}
    for name, (kind, lo, hi) in ranges.items():
        a, b = (np.log(lo), np.log(hi)) if kind == "log" else (lo, hi)
        if around is None:
            v = rng.uniform(a, b)
        else:
            c = np.log(around[name]) if kind == "log" else around[name]
            v = np.clip(rng.normal(c, 0.2 * (b - a)), a, b)
        out[name] = float(np.exp(v)) if kind == "log" else int(round(v)) if kind == "int" else float(v)
    return out


def measure(name: str, m: DataFrame, k: int, params: dict, step: str, n: int, methods=None, keep: bool = False, around: int = AROUND) -> dict:
    """Run one method and measure it; a numeric failure is a result with quality 0 and its reason as status."""
    t = time.time()
    out = {"rel_err": 0.0, "r2": 0.0, "step": step, "fun_id": name, "rows_cols": f"{n}_{width(m)}", "dim_low": k,
           "hyperparameters": json.dumps(params), "status": "ok", "data_lowdim": None, "rows_quality": 0}
    try:
        emb = cut((methods or METHODS)[name].fit(m, k, **params), "embedding")
        got, out["rows_quality"] = measured_quality(emb, around, n)
        out |= got
        if keep:
            out["data_lowdim"] = emb.select("key", "y")
    except (ArithmeticError, ValueError, np.linalg.LinAlgError, PythonException) as e:
        # what a method may do to a matrix it does not suit; a failing cluster or driver is not a property of the method
        if isinstance(e, PythonException) and not any(x in str(e) for x in NUMERIC):
            raise
        out["status"] = f"{type(e).__name__}: {str(e)[:200]}"
    out["time"] = time.time() - t
    return out


def step_size(d: int) -> int:
    return max(round(d**0.25) - 1, 1) if d > 150 else 1


def pca_quality(m: DataFrame, dims: list[int], n: int, around: int = AROUND) -> tuple[dict[int, float], int]:
    """rel_err of several principal dimensions from one decomposition and one ranked sample, and the rows of the sample."""
    d = width(m)
    full = L.pca(m, d)
    rows = sample_pairs(full.transform(m.select("key", "x")), around, n)
    high, low = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    sums = rank_sums(m.sparkSession, high, [low[:, :k] for k in dims])
    return {k: quality_from_sums(len(rows), *sums[i])["rel_err"] for i, k in enumerate(dims)}, len(rows)


def target_dimension(m: DataFrame, n: int, cutoff: float, start: int | None = None, around: int = AROUND) -> tuple[int, list[dict]]:
    """Smallest dimension whose principal embedding reaches the cutoff.

    Without a start the range is narrowed by grids of probes, all measured in one job; with a start the
    neighbours are tried in steps.
    """
    d = width(m)
    seen: dict[int, float] = {}
    used = 0

    def probe(ks):
        nonlocal used
        new = [k for k in ks if k not in seen]
        if new:
            got, used = pca_quality(m, new, n, around)
            seen.update(got)

    if start is None:
        lo, hi = 0, d   # lo fails, hi is taken to hold
        while hi - lo > 1:
            ks = sorted({lo + max(1, round((hi - lo) * i / 5)) for i in range(1, 5)} - {hi, lo}) or [lo + 1]
            probe(ks)
            good = [k for k in ks if seen[k] >= cutoff]
            if good:
                hi = min(good)
            lo = max([k for k in ks if k < hi and seen[k] < cutoff], default=lo)
        k = hi
    else:
        step, k = step_size(d), start
        probe([k])
        if seen[k] >= cutoff:
            while k - step >= 1:
                probe([k - step])
                if seen[k - step] < cutoff:
                    break
                k -= step
        else:
            while k < d and seen[k] < cutoff:
                k = min(k + step, d)
                probe([k])
    return k, [{"fun_id": "py_pca", "step": "1_target_dim", "dim_low": q, "rel_err": v, "status": "ok", "hyperparameters": "{}",
                "rows_cols": f"{n}_{d}", "time": 0.0, "r2": None, "rows_quality": used} for q, v in sorted(seen.items())]


def trial_budget(n_params: int) -> tuple[int, int]:
    """First draws and further draws of the search: one run when there is nothing to choose."""
    return (1, 0) if n_params == 0 else (5 + 2 * (n_params - 1), 5 * n_params)


def search_method(name: str, m: DataFrame, k: int, n: int, seed: int = 1, methods=None, budget=trial_budget,
                  time_limit: float | None = None, around: int = AROUND) -> list[dict]:
    """Random draws over the ranges, then draws near the best so far. ``time_limit`` in seconds, if given, ends the search after a draw."""
    ranges = (methods or METHODS)[name].ranges
    first, more = budget(len(ranges))
    rng, began, out = np.random.default_rng([seed, sum(map(ord, name))]), time.time(), []
    for i in range(first + more):
        best = max(out, key=lambda r: r["rel_err"]) if out else None
        params = draw_params(ranges, rng, json.loads(best["hyperparameters"]) if best and i >= first else None)
        out.append(measure(name, m, k, params, "2_functions", n, methods, around=around))
        if time_limit and time.time() - began > time_limit:
            break
    return out


def best_trials(trials: DataFrame) -> DataFrame:
    """The trial with the best quality of each method, the earlier one on ties."""
    w = W.partitionBy("fun_id").orderBy(F.desc("rel_err"), "trial")
    return trials.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def above_cutoff(best: list[dict], cutoff: float, fallback: dict) -> list[dict]:
    """Methods that reach the cutoff; the principal embedding if none does."""
    return [r for r in best if r["rel_err"] >= cutoff] or [fallback]


def intrinsic_dimension(m: DataFrame, start: int, chosen: list[dict], cutoff: float, n: int, methods=None,
                        around: int = AROUND) -> tuple[int, list[dict], list[dict]]:
    """Walk down while some method holds the cutoff, up while none does. Returns dimension, its results, all results."""
    d, runs = width(m), {}

    def run(k):
        if k not in runs:
            runs[k] = [measure(r["fun_id"], m, k, json.loads(r["hyperparameters"]), "3_fulldata", n, methods, True, around) for r in chosen]
        return any(r["rel_err"] >= cutoff for r in runs[k])

    k = max(1, min(start, d))
    down = run(k)
    while True:  # k only falls or only rises between 1 and d
        if down:
            if k == 1 or not run(k - 1):
                break
            k -= 1
        else:
            if k >= d:
                break
            k += 1
            if run(k):
                break
    good = [r for r in runs[k] if r["rel_err"] >= cutoff] or runs[k]
    return k, good, [r for rs in runs.values() for r in rs]


SUMMARY_SCHEMA = ("trial int, step string, fun_id string, dim_low int, rel_err double, r2 double, rows_cols string, "
                  "hyperparameters map<string,string>, status string, time double, rows_quality int")


def complexity(data_high: DataFrame, data_id: str | None = None, columns=("All",), cutoff_loss: float = 0.99, functions=("All",),
               docu: bool = False, keys: list[str] | None = None, matrix_col: str | None = None, seed: int = 1, methods=None, budget=trial_budget,
               scale: bool = True, around: int = AROUND) -> tuple[int, list[dict], DataFrame]:
    """Intrinsic dimension, the best results at it, and a summary of everything tried.

    ``matrix_col`` names a ready array column; otherwise all numeric columns but the keys are used.
    ``data_id`` is a label for the caller, and the summary is always returned, whatever ``docu`` says.
    Quality is measured on about ``around`` rows; the summary says for each trial how many they were.
    """
    spark = data_high.sparkSession
    functions = [functions] if isinstance(functions, str) else list(functions or ["All"])
    methods = methods or METHODS
    keyed = with_key(data_high, keys)
    if matrix_col:
        m = as_matrix(keyed, "__key", matrix_col)
    else:
        cols = [c for c in numeric_columns(project(data_high, list(columns))) if c not in (keys or [])]
        bad = bad_columns(keyed, cols)
        m = as_matrix(keyed, "__key", [c for c in cols if c not in bad])
    m = cut(m, "matrix")
    if scale:
        m = cut(standardize_matrix(m, matrix_moments(m, width(m))[0]), "scaled")
    n = m.count()
    small = cut(reduce_rows(m, ["key"], seed, n=n, n_cols=width(m)), "small")
    n_small = small.count()
    rough, trace1 = target_dimension(small, n_small, cutoff_loss, around=around)
    target, trace2 = target_dimension(m, n, cutoff_loss, rough, around)
    trials = [r for f in exclude_names(list(methods), functions) for r in search_method(f, small, target, n_small, seed, methods, budget, around=around)]
    table = spark.createDataFrame([(i, r["fun_id"], float(r["rel_err"])) for i, r in enumerate(trials)], "trial int, fun_id string, rel_err double")
    best = [trials[r["trial"]] for r in best_trials(table).collect()]
    fallback = {"fun_id": "py_pca", "hyperparameters": "{}", "rel_err": 0.0}
    dim, results, trace3 = intrinsic_dimension(m, target, above_cutoff(best, cutoff_loss, fallback), cutoff_loss, n, methods, around)
    rows = [(i, r["step"], r["fun_id"], int(r["dim_low"]), float(r["rel_err"]), None if r["r2"] is None else float(r["r2"]), r["rows_cols"],
             {k: str(v) for k, v in json.loads(r["hyperparameters"]).items()}, r["status"], float(r["time"]), r["rows_quality"])
            for i, r in enumerate(trace1 + trace2 + trials + trace3)]
    return dim, results, spark.createDataFrame(rows, SUMMARY_SCHEMA)
