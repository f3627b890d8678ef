"""Model-X knockoffs (Candes, Fan, Janson and Lv 2018) with Gaussian columns.

Knockoff rows are a linear map of the row plus noise fixed by (key, run), so any task can make them
again. One scan yields the second moments of [X, knockoffs, y] for all runs and folds; the penalised
fits then need those matrices only and are solved run by run in parallel.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.keys import fold
from ..session import cut
from .gram import table_moments
from .ranking import consolidate_runs, select_features
from .shapley import hash_normal

FSTATS = ["lasso", "ridge", "randomforest"]
FOLDS = 5
RUN_SCHEMA = "fstat string, run int, feature string, w double"


class Sampler:
    """Standardises a block of rows and makes its knockoffs."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray):
        sd = np.sqrt(np.diag(cov))
        self.mean, self.sd = mean, np.where(sd > 0, sd, 1.0)
        corr = cov / np.outer(self.sd, self.sd)
        np.fill_diagonal(corr, 1.0)
        # equicorrelated construction, kept a little inside the cone
        s = float(np.clip(2 * np.linalg.eigvalsh(corr)[0], 1e-6, 1.0)) * 0.999
        inv = np.linalg.pinv(corr, hermitian=True)
        self.s = np.full(len(sd), s)
        self.shrink = np.eye(len(sd)) - s * inv
        val, vec = np.linalg.eigh(2 * s * np.eye(len(sd)) - s * s * inv)
        self.noise = vec * np.sqrt(np.maximum(val, 0)) @ vec.T

    def __call__(self, x: np.ndarray, key: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
        z = (x - self.mean) / self.sd
        return z, z @ self.shrink + hash_normal(key, run, z.shape[1]) @ self.noise


def fit_sampler(df: DataFrame, cols: list[str]) -> Sampler:
    mo = table_moments(df, cols)
    return Sampler(mo.mean, mo.cov)


def knockoff_rows(df: DataFrame, cols: list[str], sampler: Sampler, run: int, keep: list[str] = ()) -> DataFrame:
    """``key``, kept columns, ``x``: the standardised row followed by its knockoffs."""
    d, first = len(cols), 1 + len(keep)

    def make(batches):
        for b in batches:
            if len(b):
                x = np.column_stack([b.column(first + i).to_numpy(zero_copy_only=False) for i in range(d)]).astype(float)
                flat = np.hstack(sampler(x, b.column(0).to_numpy(zero_copy_only=False), run)).ravel()
                both = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * d, dtype=np.int32)), pa.array(flat, from_pandas=True))
                yield pa.RecordBatch.from_arrays([*b.columns[:first], both], ["key", *keep, "x"])

    schema = "key bigint, " + "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep) + "x array<double>"
    return df.select("key", *keep, *cols).mapInArrow(make, schema)


def run_moments(df: DataFrame, cols: list[str], y: str, sampler: Sampler, runs: list[int]) -> DataFrame:
    """``run, fold, slot, v``: packed sums of [1, X, knockoffs, y] per run and fold, from one scan."""
    d = len(cols)
    iu = np.triu_indices(2 * d + 2)

    def partials(batches):
        acc: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            key = b.column(0).to_numpy(zero_copy_only=False)
            f = b.column(1).to_numpy(zero_copy_only=False)
            yv = b.column(2).to_numpy(zero_copy_only=False)
            x = np.column_stack([b.column(3 + i).to_numpy(zero_copy_only=False) for i in range(d)])
            for run in runs:
                z, k = sampler(x, key, run)
                a = np.column_stack([np.ones(len(z)), z, k, yv])
                for g in np.unique(f):
                    part = a[f == g]
                    v = (part.T @ part)[iu]
                    acc[(run, g)] = v if (run, g) not in acc else acc[(run, g)] + v
        for (run, g), v in acc.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), run, np.int32)), pa.array(np.full(len(v), g, np.int32)),
                 pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["run", "fold", "slot", "v"])

    src = df.select("key", fold("key", FOLDS, 3).alias("fold"), F.col(y).cast("double"), *[F.col(c).cast("double") for c in cols])
    return src.mapInArrow(partials, "run int, fold int, slot int, v double").groupBy("run", "fold", "slot").agg(F.sum("v").alias("v"))


def _split(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Centred per-row moments: n, covariance of the columns, their covariance with y, variance of y."""
    n = m[0, 0]
    c = m[1:, 1:] / n - np.outer(m[0, 1:], m[0, 1:]) / n**2
    return n, c[:-1, :-1], c[:-1, -1], c[-1, -1]


def _lasso(c: np.ndarray, r: np.ndarray, lam: float, start: np.ndarray, sweeps: int = 300) -> np.ndarray:
    b = start.copy()
    for _ in range(sweeps):
        gap = 0.0
        for j in range(len(b)):
            old = b[j]
            g = r[j] - c[j] @ b + c[j, j] * old
            b[j] = np.sign(g) * max(abs(g) - lam, 0.0) / max(c[j, j], 1e-12)
            gap = max(gap, abs(b[j] - old))
        if gap < 1e-9:
            break
    return b


def penalised_fit(parts: dict[int, np.ndarray], fstat: str) -> np.ndarray:
    """Coefficients at the penalty with the least cross-validated squared error, all from moments."""
    total = sum(parts.values())
    _, c, r, _ = _split(total)
    top = max(np.abs(r).max(), 1e-12)
    grid = top * np.geomspace(1.0, 1e-3, 20) if fstat == "lasso" else np.geomspace(1e2, 1e-3, 16)

    def path(c, r):
        b, out = np.zeros(len(r)), []
        for lam in grid:
            b = _lasso(c, r, lam, b) if fstat == "lasso" else np.linalg.solve(c + lam * np.eye(len(r)), r)
            out.append(b)
        return out

    err = np.zeros(len(grid))
    for f, part in parts.items():
        rest = total - part
        if rest[0, 0] < 2 or part[0, 0] < 1:
            continue
        n, hc, hr, hv = _split(part)
        gap = part[0, 1:] / part[0, 0] - rest[0, 1:] / rest[0, 0]
        for i, b in enumerate(path(*_split(rest)[1:3])):
            # error of the held-out fold, its mean being predicted by the others'
            err[i] += n * (hv - 2 * b @ hr + b @ hc @ b + (gap[-1] - gap[:-1] @ b) ** 2)
    return path(c, r)[int(np.argmin(err))]


def linear_statistics(df: DataFrame, cols: list[str], y: str, sampler: Sampler, runs: list[int], fstats: list[str]) -> DataFrame:
    d, size = len(cols), 2 * len(cols) + 2
    iu = np.triu_indices(size)

    def solve(f):
        parts = {}
        for g, p in f.groupby("fold"):
            m = np.zeros((size, size))
            p = p.sort_values("slot")
            m[iu] = p["v"].to_numpy()
            parts[g] = m + np.triu(m, 1).T
        run, out = int(f["run"].iloc[0]), []
        for s in fstats:
            b = np.abs(penalised_fit(parts, s))
            out.append(pd.DataFrame({"fstat": s, "run": run, "feature": cols, "w": b[:d] - b[d:]}))
        return pd.concat(out)

    return run_moments(df, cols, y, sampler, runs).groupBy("run").applyInPandas(solve, RUN_SCHEMA)


def forest_statistics(df: DataFrame, cols: list[str], y: str, sampler: Sampler, run: int, trees: int = 100, depth: int = 15) -> DataFrame:
    """Importance of each column minus that of its knockoff in one forest over both."""
    d = len(cols)
    # the forest reads its rows three times before it holds them as bins: the knockoffs are made once
    made = cut(knockoff_rows(df, cols, sampler, run, [y]).select(F.col(y).cast("double").alias("label"), "x"), "forest")
    rows = made.select("label", array_to_vector("x").alias("features"))
    imp = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=run).fit(rows).featureImportances.toArray()
    return df.sparkSession.createDataFrame([("randomforest", run, c, float(imp[i] - imp[d + i])) for i, c in enumerate(cols)], RUN_SCHEMA)


def simulate_knockoffs(df: DataFrame, cols: list[str], y: str, fdr: float = 0.1, fstats: list[str] | None = None, itr: int = 20,
                       zero_selected: bool = True, trees: int = 100, depth: int = 15, parallelism: int = 4) -> tuple[DataFrame, DataFrame]:
    """Runs table ``fstat, run, feature, w, selected`` and the consolidated scores.

    ``df`` has a unique ``key BIGINT``. Every run has its own noise. ``trees`` and ``depth`` are those of the forest statistic.
    """
    fstats = fstats or FSTATS
    df = df.dropna("any", subset=[*cols, y])
    sampler, runs = fit_sampler(df, cols), list(range(1, itr + 1))
    linear = [s for s in fstats if s != "randomforest"]
    stats = linear_statistics(df, cols, y, sampler, runs, linear) if linear else None
    if "randomforest" in fstats:
        stored = cut(df, "knockoffs")  # read by every run's forest
        with ThreadPool(max(1, parallelism)) as pool:
            for part in pool.map(lambda r: forest_statistics(stored, cols, y, sampler, r, trees, depth), runs):
                stats = part if stats is None else stats.unionByName(part)
    flagged = select_features(stats, fdr, ["fstat", "run"]).select("fstat", "run", "feature", "w", "selected")
    return flagged, consolidate_runs(flagged, zero_selected=zero_selected)
