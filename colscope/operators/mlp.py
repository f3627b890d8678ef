"""Small neural regressors trained on partitions in parallel.

Every round each shard of rows improves its networks with mini-batch Adam and the weights are
averaged, rows being the weights of the mean (parameter averaging; Zinkevich et al. 2010). All tuples,
grid points and folds share a round, so a round is one pass over the training rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

# fixed values: the grid tried unless the caller gives another
HIDDEN = [(12,), (50,), (70, 5)]
ALPHAS = [0.001, 0.0001, 0.00001]

BATCH, B1, B2, EPS = 200, 0.9, 0.999, 1e-8
WEIGHTS = 1 << 20  # of the networks that learn together: what a task gets and a round sends back
SHARD = 5_000  # rows that one task fits to between two averages


@dataclass
class Net:
    """One network: which rows train it, its shape, penalty, input scaling and flat weights."""

    net_id: int
    gid: int
    skip_fold: int            # rows of this fold are left out; -1 trains on all
    sizes: list[int]
    alpha: float
    mean: np.ndarray
    sd: np.ndarray
    y_mean: np.ndarray
    y_sd: np.ndarray
    w: np.ndarray
    state: dict = field(default_factory=dict)


def unpack(w: np.ndarray, sizes: list[int]):
    at, layers = 0, []
    for a, b in zip(sizes[:-1], sizes[1:]):
        layers.append((w[at:at + a * b].reshape(a, b), w[at + a * b:at + a * b + b]))
        at += a * b + b
    return layers


def start(sizes: list[int], seed: int) -> np.ndarray:
    """Glorot-uniform weights and biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
        bound = np.sqrt((6.0 if i < len(sizes) - 2 else 2.0) / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def forward(net: Net, x: np.ndarray) -> np.ndarray:
    h = (x - net.mean) / net.sd
    layers = unpack(net.w, net.sizes)
    for i, (w, b) in enumerate(layers):
        h = h @ w + b
        if i < len(layers) - 1:
            h = np.maximum(h, 0)
    return h * net.y_sd + net.y_mean


def input_gradient(net: Net, x: np.ndarray, output: int = 0) -> np.ndarray:
    """Derivative of one output by the inputs, row by row."""
    layers = unpack(net.w, net.sizes)
    h, live = (x - net.mean) / net.sd, []
    for w, b in layers[:-1]:
        z = h @ w + b
        live.append(z > 0)
        h = np.maximum(z, 0)
    g = np.repeat(layers[-1][0][:, output][None], len(x), axis=0)
    for (w, _), on in zip(reversed(layers[:-1]), reversed(live)):
        g = (g * on) @ w.T
    return g * net.y_sd[output] / net.sd


def _gradient(net: Net, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    layers = unpack(w, net.sizes)
    acts = [x]
    for i, (wt, b) in enumerate(layers):
        z = acts[-1] @ wt + b
        acts.append(np.maximum(z, 0) if i < len(layers) - 1 else z)
    delta, grads = (acts[-1] - y) / len(x), []
    for i in range(len(layers) - 1, -1, -1):
        wt = layers[i][0]
        grads.append((acts[i].T @ delta + net.alpha * wt / len(x), delta.sum(axis=0)))
        if i:
            delta = (delta @ wt.T) * (acts[i] > 0)
    return np.concatenate([np.concatenate([g.ravel(), b]) for g, b in reversed(grads)])


def _local_steps(net: Net, x: np.ndarray, y: np.ndarray, epochs: int, rate: float, seed: int) -> np.ndarray:
    w = net.w.copy()
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    xs, ys = (x - net.mean) / net.sd, (y - net.y_mean) / net.y_sd
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for a in range(0, len(xs), BATCH):
            g = _gradient(net, w, xs[order[a:a + BATCH]], ys[order[a:a + BATCH]])
            t += 1
            m, v = B1 * m + (1 - B1) * g, B2 * v + (1 - B2) * g * g
            w = w - rate * (m / (1 - B1**t)) / (np.sqrt(v / (1 - B2**t)) + EPS)
    return w


def train(points: DataFrame, nets: list[Net], rounds: int = 8, epochs: int = 20, rate: float = 0.01,
          tol: float = 1e-4, seed: int = 1) -> list[Net]:
    """Fit the networks to ``points`` (gid int, fold int, x array, y array).

    The driver holds weights only. The rows of a gid (``points`` has gid, key, fold, x and y) are dealt to shards of about ``SHARD`` rows by their key, so equal rows
    spread; in each round a shard goes ``epochs`` times over its rows, starting from the common weights, then these are averaged. Shards
    follow from the keys alone, so the networks do not depend on the cluster or on how the input is partitioned. Networks learn in waves of at most ``WEIGHTS`` weights.
    """
    points = points.select("gid", "key", "fold", "x", "y").withColumn("h", F.xxhash64("gid", "key"))
    sizes = cut(points.groupBy("gid").agg(F.ceil(F.count("*") / SHARD).alias("shards")), "shards")
    parts = int(sizes.agg(F.sum("shards")).first()[0] or 1)
    dealt = points.join(sizes, "gid").withColumn("shard", F.pmod("h", "shards")).drop("shards")
    rows = cut(dealt.repartition(parts, "gid", "shard").sortWithinPartitions("gid", "shard", "h", "key").drop("key"), "mlp")
    wave: list[Net] = []
    for i, n in enumerate(nets):
        wave.append(n)
        if sum(len(m.w) for m in wave) >= WEIGHTS or i == len(nets) - 1:
            _rounds(rows, wave, rounds, epochs, rate, tol, seed)
            wave = []
    return nets


def _rounds(rows: DataFrame, nets: list[Net], rounds: int, epochs: int, rate: float, tol: float, seed: int) -> None:
    """Improves networks side by side until none moves."""
    for rnd in range(rounds):
        by_gid: dict[int, list[Net]] = {}
        for n in nets:
            by_gid.setdefault(n.gid, []).append(n)
        step = rate / (1 + 0.3 * rnd)

        def improve(frames):
            # a shard's rows follow each other; its weights are added to those of the task's other shards
            total: dict[int, list] = {}

            def fit(f):
                x, y = np.array(f["x"].tolist(), dtype=float), np.array(f["y"].tolist(), dtype=float)
                fold = f["fold"].to_numpy()
                for n in by_gid.get(f["gid"].iloc[0], []):
                    use = fold != n.skip_fold
                    if use.any():
                        w, rows = _local_steps(n, x[use], y[use], epochs, step, seed + rnd), int(use.sum())
                        sums = total.setdefault(n.net_id, [0.0, np.zeros_like(w)])
                        sums[0], sums[1] = sums[0] + rows, sums[1] + rows * w

            waiting: list = []
            for f in frames:
                for key, part in f.groupby(["gid", "shard"]):
                    if waiting and (waiting[0]["gid"].iloc[0], waiting[0]["shard"].iloc[0]) != key:
                        fit(pd.concat(waiting))
                        waiting = []
                    waiting.append(part)
            if waiting:
                fit(pd.concat(waiting))
            for i, (n, wn) in total.items():
                yield pd.DataFrame({"net_id": i, "slot": np.arange(len(wn)), "n": n, "wn": wn})

        sums = (rows.mapInPandas(improve, "net_id int, slot int, n double, wn double")
                .groupBy("net_id", "slot").agg((F.sum("wn") / F.sum("n")).alias("w")).collect())
        new: dict[int, np.ndarray] = {}
        size = {n.net_id: len(n.w) for n in nets}
        for r in sums:
            new.setdefault(r["net_id"], np.zeros(size[r["net_id"]]))[r["slot"]] = r["w"]
        moved = 0.0
        for n in nets:
            if n.net_id in new:
                moved = max(moved, float(np.abs(new[n.net_id] - n.w).max()))
                n.w = new[n.net_id]
        if moved < tol:
            break


def predict(points: DataFrame, nets: list[Net], keep: list[str]) -> DataFrame:
    """``keep`` columns, net_id and prediction array for every row and every network of its gid."""
    by_gid: dict[int, list[Net]] = {}
    for n in nets:
        by_gid.setdefault(n.gid, []).append(n)

    def run(frames):
        for f in frames:
            for gid, part in f.groupby("gid"):
                x = np.array(part["x"].tolist(), dtype=float)
                for n in by_gid.get(gid, []):
                    out = part[keep].copy()
                    out["net_id"] = n.net_id
                    out["p"] = list(forward(n, x))
                    yield out

    schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in keep) + ", net_id int, p array<double>"
    return points.select("gid", "x", *[c for c in keep if c not in ("gid", "x")]).mapInPandas(run, schema)
