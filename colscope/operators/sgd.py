"""Linear regression by averaged proximal stochastic gradient steps.

Rows are dealt once into shards of bounded size by a hash of their key and stored packed, one record per shard, so a shard is the same whatever the partitions
and the values are. In every epoch each shard takes its rows in a drawn order from the common weights; the tasks send sums of the shards' weights, and their mean, by rows, starts the
next epoch. The loss is one of squared, huber and epsilon-insensitive; after each step the penalty's proximal map follows, so small weights become zero under l1.

Inputs and target are standardised inside (the target by its quartiles where the loss is a robust one) and the weights given back in their units; ``epsilon`` is in units of the target, the penalty acts on standardised weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .quantiles import exact_quantiles

SHARD = 1 << 18  # numbers of a shard
STEP = 32        # rows of a step


@dataclass
class Descent:
    loss: str = "squared"  # squared, huber, epsilon_insensitive
    alpha: float = 1e-4
    l1_ratio: float = 0.15
    schedule: str = "invscaling"  # or constant
    eta0: float = 0.01
    power_t: float = 0.25
    epsilon: float = 0.1
    intercept: bool = True
    epochs: int = 200
    tolerance: float = 1e-4
    patience: int = 5
    seed: int = 1

    def rate(self, t: int) -> float:
        return self.eta0 if self.schedule == "constant" else self.eta0 / t**self.power_t


def slope(miss: np.ndarray, p: Descent, epsilon: float) -> np.ndarray:
    """Derivative of the loss by the prediction, from prediction - target."""
    if p.loss == "squared":
        return miss
    if p.loss == "huber":
        return np.clip(miss, -epsilon, epsilon)
    if p.loss == "epsilon_insensitive":
        return np.where(miss > epsilon, 1.0, np.where(miss < -epsilon, -1.0, 0.0))
    raise ValueError(f"unknown loss {p.loss!r}; known: squared, huber, epsilon_insensitive")


def worth(miss: np.ndarray, p: Descent, epsilon: float) -> np.ndarray:
    size = np.abs(miss)
    if p.loss == "squared":
        return miss**2 / 2
    if p.loss == "huber":
        return np.where(size <= epsilon, miss**2 / 2, epsilon * (size - epsilon / 2))
    return np.maximum(size - epsilon, 0)


def epoch(x: np.ndarray, y: np.ndarray, w: np.ndarray, p: Descent, epsilon: float, t: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last and mean weights (the intercept last) of one pass over a shard, whose first step has number ``t``."""
    w, mean, steps = w.copy(), np.zeros_like(w), 0
    for a in range(0, len(y), STEP):
        rows = order[a:a + STEP]
        eta = p.rate(t + steps)
        g = slope(x[rows] @ w[:-1] + w[-1] - y[rows], p, epsilon)
        with np.errstate(over="ignore", invalid="ignore"):
            v = w[:-1] - eta * (g @ x[rows]) / len(rows)
            v = np.sign(v) * np.maximum(np.abs(v) - eta * p.alpha * p.l1_ratio, 0) / (1 + eta * p.alpha * (1 - p.l1_ratio))
            w = np.append(v, w[-1] - eta * g.mean() if p.intercept else 0.0)
        steps += 1
        mean += (w - mean) / steps
    return w, mean


def packed(rows: DataFrame, d: int, shift: np.ndarray, scale: np.ndarray) -> DataFrame:
    """One record per shard: its number of rows, standardised inputs and targets."""
    n = rows.count()
    shards = max(1, -(-n * (d + 1) // SHARD))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        z = (np.column_stack([np.stack(pdf["x"]), pdf["label"]]) - shift) / scale
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "n": [len(pdf)], "z": [z.tobytes()]})

    src = rows.select(F.pmod(F.xxhash64(F.lit(23), "key"), F.lit(shards)).alias("shard"), "key", "x", F.col("label").cast("double").alias("label"))
    return cut(src.groupBy("shard").applyInPandas(pack, "shard long, n long, z binary"), "shards")


def fit_descent(rows: DataFrame, p: Descent) -> tuple[float, np.ndarray]:
    """Intercept and weights; ``rows`` has key, x and label. Raises ArithmeticError where the steps run away."""
    d = len(rows.select("x").first()["x"])
    cols = [F.col("x")[i] for i in range(d)] + [F.col("label")]
    got = rows.agg(*[f(c) for c in cols for f in (F.avg, F.stddev_pop)]).first()
    shift, scale = np.array(got[::2], float), np.array([s or 1.0 for s in got[1::2]], float)
    if p.loss != "squared":  # a few wild targets must not set the units
        low, middle, high = exact_quantiles(rows.select(F.col("label").cast("double").alias("label")), ["label"], [0.25, 0.5, 0.75])["label"]
        if high > low:
            shift[-1], scale[-1] = middle, (high - low) / 1.349
    if not p.intercept:
        shift = np.zeros(d + 1)
    table = packed(rows, d, shift, scale)
    epsilon = p.epsilon / scale[-1]
    w, t, best, stale, last = np.zeros(d + 1), 1, np.inf, 0, np.zeros(d + 1)
    per_epoch = max(1, -(-table.agg(F.max("n")).first()[0] // STEP))
    for e in range(p.epochs):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * (d + 1) + 2)
            for b in batches:
                for shard, n, z in zip(*(b.column(c).to_pylist() for c in ("shard", "n", "z"))):
                    z = np.frombuffer(z).reshape(n, d + 1)
                    order = np.random.default_rng([p.seed, e, shard]).permutation(n)
                    now, mean = epoch(z[:, :-1], z[:, -1], w, p, epsilon, t, order)
                    loss = worth(z[:, :-1] @ mean[:-1] + mean[-1] - z[:, -1], p, epsilon).sum()
                    total += np.r_[n * now, n * mean, loss, n]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        sums = np.sum([r["sums"] for r in table.mapInArrow(run, "sums array<double>").collect()], axis=0)
        n = sums[-1]
        if not np.isfinite(sums).all():
            raise ArithmeticError("the steps are too long for these rows")
        w, last, loss = sums[:d + 1] / n, sums[d + 1:2 * (d + 1)] / n, sums[-2] / n
        t += per_epoch
        stale = stale + 1 if loss > best - p.tolerance * max(abs(best), 1e-12) and np.isfinite(best) else 0
        best = min(best, loss)
        if stale >= p.patience:
            break
    coef = last[:-1] * scale[-1] / scale[:-1]
    return float(shift[-1] + last[-1] * scale[-1] - coef @ shift[:-1]), coef
