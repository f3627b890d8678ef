"""Linear embeddings. Each needs one scan for second moments, small algebra, and one row map."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..session import cut, dealt
from .gram import Moments
from .matrix import map_packed, map_rows, matrix_moments, packed, unpacked, width

TASK_ROWS = 100_000  # more rows in a task are spread where cores would be idle


@dataclass
class Projection:
    """y = (x - mean) @ weights."""

    mean: np.ndarray
    weights: np.ndarray
    values: np.ndarray

    def transform(self, m: DataFrame, out: str = "y") -> DataFrame:
        mean, w = self.mean, self.weights
        return map_rows(m, lambda x: (x - mean) @ w, out)

    def first(self, k: int) -> "Projection":
        return Projection(self.mean, self.weights[:, :k], self.values[:k])


def _eigen(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descending eigenpairs; the entry of largest size in each vector is positive."""
    val, vec = np.linalg.eigh((c + c.T) / 2)
    val, vec = val[::-1], vec[:, ::-1]
    sign = np.sign(vec[np.argmax(np.abs(vec), axis=0), np.arange(vec.shape[1])])
    return val, vec * np.where(sign == 0, 1, sign)


def pca_from(mo: Moments, k: int) -> Projection:
    val, vec = _eigen(mo.cov)
    return Projection(mo.mean, vec[:, :k], val[:k])


def pca(m: DataFrame, k: int) -> Projection:
    return pca_from(matrix_moments(m, width(m))[0], k)


def classical_scaling(m: DataFrame, k: int) -> Projection:
    """For Euclidean distances classical scaling gives the principal scores."""
    return pca(m, k)


def truncated_svd(m: DataFrame, k: int) -> Projection:
    """Uncentred: eigenvectors of the second moment about the origin."""
    mo = matrix_moments(m, width(m))[0]
    val, vec = _eigen(mo.scatter + mo.n * np.outer(mo.mean, mo.mean))
    return Projection(np.zeros(len(mo.mean)), vec[:, :k], np.sqrt(np.maximum(val[:k], 0)))


def merge_moments(parts: list[Moments]) -> Moments:
    """Moments of the union of disjoint row sets."""
    parts = [p for p in parts if p.n]
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / n
    return Moments(n, mean, sum(p.scatter + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts))


def incremental_pca(batches, k: int) -> Projection:
    """Principal components from batches of rows; only their moments are kept."""
    total: Moments | None = None
    for m in batches:
        mo = matrix_moments(m, width(m))[0]
        total = mo if total is None else merge_moments([total, mo])
    return pca_from(total, k)


def probabilistic_pca(m: DataFrame, k: int) -> Projection:
    mo = matrix_moments(m, width(m))[0]
    val, vec = _eigen(mo.cov)
    noise = float(val[k:].mean()) if k < len(val) else 0.0
    w = vec[:, :k] * np.sqrt(np.maximum(val[:k] - noise, 0))
    return Projection(mo.mean, w @ np.linalg.pinv(w.T @ w + noise * np.eye(k)), val[:k])


def geometric_median(mats: list[np.ndarray], iters: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Weiszfeld iteration under the Frobenius norm."""
    cur = np.mean(mats, axis=0)
    for _ in range(iters):
        dist = np.array([max(np.linalg.norm(c - cur), 1e-12) for c in mats])
        new = np.tensordot(1 / dist, np.array(mats), axes=1) / np.sum(1 / dist)
        if np.linalg.norm(new - cur) <= tol * max(np.linalg.norm(cur), 1e-300):
            return new
        cur = new
    return cur


def robust_pca(m: DataFrame, k: int, subsets: int = 5) -> Projection:
    """Eigenvectors of the geometric median of subset covariances; the subsets come from one grouped scan."""
    parts = [p for p in matrix_moments(m, width(m), subsets) if p.n > 1]
    val, vec = _eigen(geometric_median([p.cov for p in parts]))
    return Projection(merge_moments(parts).mean, vec[:, :k], val[:k])


def sparse_pca(m: DataFrame, k: int, alpha: float = 0.01, ridge: float = 0.1, iters: int = 100, tol: float = 1e-8) -> Projection:
    """Sparse loadings by alternating regressions on the covariance (Zou, Hastie and Tibshirani 2006).

    The method needs second moments only, so the rows are read once. Scores are the ridge solution.
    """
    mo = matrix_moments(m, width(m))[0]
    c = mo.cov
    a = _eigen(c)[1][:, :k]
    b, curv = a.copy(), np.diag(c)
    for _ in range(iters):
        old = b.copy()
        target = c @ a
        for j in range(k):
            for _ in range(50):
                before = b[:, j].copy()
                for i in range(len(c)):
                    rest = target[i, j] - c[i] @ b[:, j] + curv[i] * b[i, j]
                    b[i, j] = np.sign(rest) * max(abs(rest) - alpha / 2, 0) / (curv[i] + 1e-12)
                if np.abs(b[:, j] - before).max() < tol:
                    break
        u, _, vt = np.linalg.svd(c @ b, full_matrices=False)
        a = u @ vt
        if np.abs(b - old).max() < tol:
            break
    norm = np.linalg.norm(b, axis=0)
    b = b / np.where(norm > 0, norm, 1.0)
    return Projection(mo.mean, b @ np.linalg.inv(b.T @ b + ridge * np.eye(k) / max(mo.n, 1)), norm)


def _spread(m: DataFrame, n: float) -> DataFrame:
    """Rows of few large files are dealt over more; others stay, since starting centres are drawn by task."""
    tasks = max(m.rdd.getNumPartitions(), 1)
    few = tasks < m.sparkSession.sparkContext.defaultParallelism
    return dealt(m, "key", TASK_ROWS // 2, "adr") if few and n > tasks * TASK_ROWS else m


def _cluster_sums(rows: DataFrame, d: int, w: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Count and column sums of the packed rows by the centre nearest to their projection; the tasks add theirs first."""
    def run(batches):
        acc = np.zeros((len(centers), d + 1))
        for b in batches:
            x = unpacked(b.column(0), d)
            y = x @ w
            c = np.argmin([((y - v) ** 2).sum(axis=1) for v in centers], axis=0)
            near = (c[:, None] == np.arange(len(centers))).astype(float)
            acc += np.hstack([near.sum(axis=0)[:, None], near.T @ x])
        c, slot = np.divmod(np.arange(acc.size, dtype=np.int32), d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(slot, pa.int32()), pa.array(acc.ravel())], names=["c", "slot", "v"])

    # k + 1 clusters of d means: small
    got = rows.mapInArrow(run, "c int, slot int, v double").groupBy("c", "slot").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((len(centers), d + 1))
    for r in got:
        out[r["c"], r["slot"]] = r["v"]
    return out


def adaptive_reduction(m: DataFrame, k: int, maxiter: int = 100, abstol: float = 1e-3, seed: int = 1) -> Projection:
    """Alternate clustering of the projected rows with the main directions between the clusters.

    The rows are kept packed less their mean. A round maps them twice: to the projections, which are kept while they
    are clustered, and to the sums of the clusters.
    """
    mo = matrix_moments(m, width(m))[0]
    d = len(mo.mean)
    p = pca_from(mo, k)
    rows = packed(_spread(cut(m.select("key", "x"), "adr"), mo.n), mo.mean).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for it in range(maxiter):
            proj = map_packed(rows, d, p.weights).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                model = KMeans(k=k + 1, featuresCol="v", predictionCol="c", seed=seed, maxIter=20).fit(proj.select(array_to_vector("y").alias("v")))
            finally:
                proj.unpersist()
            scatter = np.zeros((d, d))
            for n, *total in _cluster_sums(rows, d, p.weights, np.array(model.clusterCenters())):
                if n:
                    diff = np.array(total) / n
                    scatter += n * np.outer(diff, diff)
            val, vec = _eigen(scatter)
            new = vec[:, :k]
            gap = np.linalg.norm(new @ new.T - p.weights @ p.weights.T)
            p = Projection(mo.mean, new, val[:k])
            if gap < abstol:
                break
    finally:
        rows.unpersist()
    return p
