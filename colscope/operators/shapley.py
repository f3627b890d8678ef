"""Attributions: Shapley values of any model, and gradient methods for networks.

A Shapley value is a weighted sum of model outputs over hybrids of the row and a baseline. Which hybrids
and with which weights is fixed at plan time, so the work is: explode rows by hybrid, let the model
transform them in bulk, and sum per row. The rows of a key stay together until they are summed.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..functions.keys import below
from ..session import cut
from .matrix import map_rows
from .order import with_position
from .ranking import mean_abs_attribution

EXACT_UP_TO = 8

# fixed values of the gradient methods
IG_STEPS = 50
NOISE_SD = 0.09
BACKGROUND_SHARE = 0.3


def coalition_weights(d: int) -> tuple[np.ndarray, np.ndarray]:
    """All 2^d hybrids (1 = value of the row) and their weights per feature."""
    masks, coefs = [], []
    for size in range(d + 1):
        for on in combinations(range(d), size):
            mask = np.zeros(d)
            mask[list(on)] = 1
            gain = factorial(size - 1) * factorial(d - size) / factorial(d) if size else 0.0
            loss = factorial(size) * factorial(d - size - 1) / factorial(d) if size < d else 0.0
            masks.append(mask)
            coefs.append(np.where(mask == 1, gain, -loss))
    return np.array(masks), np.array(coefs)


def permutation_weights(d: int, permutations: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hybrids along random feature orders and their reverses; equal hybrids are merged."""
    rng = np.random.default_rng(seed)
    found: dict[tuple, np.ndarray] = {}
    orders = []
    for _ in range(max(permutations // 2, 1)):
        p = rng.permutation(d)
        orders += [p, p[::-1]]
    for p in orders:
        mask = np.zeros(d)
        for s in range(d + 1):
            c = found.setdefault(tuple(mask), np.zeros(d))
            if s > 0:
                c[p[s - 1]] += 1 / len(orders)
            if s < d:
                c[p[s]] -= 1 / len(orders)
                mask = mask.copy()
                mask[p[s]] = 1
    return np.array(list(found)), np.array(list(found.values()))


def shapley_values(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], d: int, baseline: list[float] | None = None,
                   permutations: int = 16, seed: int = 1) -> DataFrame:
    """``key, phi ARRAY`` for rows ``key, x`` (and ``base ARRAY`` per row unless a common baseline is given).

    ``predict`` adds a column ``p`` to rows with ``key, x, features`` and keeps the others. Values of rows with one key are added up.
    """
    masks, coefs = coalition_weights(d) if d <= EXACT_UP_TO else permutation_weights(d, permutations, seed)
    base = F.array(*map(F.lit, map(float, baseline))) if baseline is not None else F.col("base")
    plan = rows.sparkSession.createDataFrame([(i, m.tolist(), c.tolist()) for i, (m, c) in enumerate(zip(masks, coefs))],
                                             "mask int, on array<double>, coef array<double>")
    # rows are numbered, so that a number per hybrid fits whatever the keys are
    numbered = with_position(rows.select(F.col("key").alias("owner"), "x", base.alias("base")), ["owner"], "row")
    src = numbered.select("owner", "row", "x", "base", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("mask"))
    # the table of hybrids depends on the number of features alone
    mixed = src.join(F.broadcast(plan), "mask")
    hybrid = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(F.col("on")[i] == 1, F.col("x")[i]).otherwise(F.col("base")[i]))
    # a neighbour model joins on key, which has to be unique per hybrid
    mixed = mixed.select((F.col("row") * len(masks) + F.col("mask")).alias("key"), "owner", "coef", hybrid.alias("x"))
    got = predict(mixed.withColumn("features", array_to_vector("x")))
    sums = got.select(F.col("owner").alias("key"), *[(F.col("coef")[j] * F.col("p")).alias(f"f{j}") for j in range(d)]).groupBy("key").agg(
        *[F.sum(f"f{j}").alias(f"f{j}") for j in range(d)])
    return sums.select("key", F.array(*[f"f{j}" for j in range(d)]).alias("phi"))


def attribution_table(phi: DataFrame, features: list[str], method: str | None = None) -> DataFrame:
    """Mean absolute attribution per feature."""
    names = F.array(*map(F.lit, features))
    long = phi.select(F.posexplode("phi").alias("i", "phi")).select(names[F.col("i")].alias("feature"), "phi")
    out = mean_abs_attribution(long)
    return out if method is None else out.withColumn("method", F.lit(method))


def with_background(rows: DataFrame, share: float = BACKGROUND_SHARE, draws: int = 1, seed: int = 1) -> DataFrame:
    """Give each row ``draws`` baselines chosen by hash from a sample of the rows: an equi-join on the sample position."""
    numbered = cut(with_position(rows.where(below("key", share, f"b{seed}")).select("key", F.col("x").alias("base")), ["key"], "pos")
                   .select("pos", "base"), "background")
    n = numbered.count() or 1
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.withColumn("pos", F.pmod(F.xxhash64(F.lit(seed), "key", "draw"), F.lit(n)))
    # the sample grows with the rows, and its stored size, compressed, would have it broadcast
    return drawn.join(numbered.hint("merge"), "pos").drop("pos")


def background_shapley(rows: DataFrame, predict, d: int, share: float = BACKGROUND_SHARE, draws: int = 4, permutations: int = 16,
                       seed: int = 1) -> DataFrame:
    """Shapley values against sampled background rows, averaged over the draws of each row."""
    drawn = with_background(rows.select("key", "x"), share, draws, seed)
    phi = shapley_values(drawn.select("key", "x", "base"), predict, d, permutations=permutations, seed=seed)
    return phi.select("key", F.transform("phi", lambda v: v / draws).alias("phi"))


def integrated_gradients(rows: DataFrame, gradient: Callable[[np.ndarray], np.ndarray], steps: int = IG_STEPS) -> DataFrame:
    """``key, phi``: the mean gradient on the straight path from zero, times the row (midpoint rule)."""
    def run(x):
        total = np.zeros_like(x)
        for s in range(steps):
            total += gradient(x * ((s + 0.5) / steps))
        return x * total / steps

    return map_rows(rows.select("key", "x"), run, "phi").select("key", "phi")


def hash_uniform(key: np.ndarray, salt: int, n: int) -> np.ndarray:
    """n uniform numbers in (0, 1) per key, the same wherever and whenever the row is computed."""
    with np.errstate(over="ignore"):
        z = key.astype(np.int64).view(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (
            np.arange(1, n + 1, dtype=np.uint64)[None] + np.uint64(salt) * np.uint64(1_000_003))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def hash_normal(key: np.ndarray, salt: int, n: int) -> np.ndarray:
    u = hash_uniform(key, salt, 2 * n)
    return np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * np.pi * u[:, n:])


def gradient_shap(rows: DataFrame, gradient: Callable[[np.ndarray], np.ndarray], noise: float = NOISE_SD, seed: int = 1) -> DataFrame:
    """``key, phi``: gradient at a random point between a random row and the noisy row, times their difference."""
    drawn = with_background(rows.select("key", "x"), 1.0, 1, seed).select("key", "x", "base")

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x, b = np.array(f["x"].tolist()), np.array(f["base"].tolist())
            keys = f["key"].to_numpy()
            x = x + noise * hash_normal(keys, seed, x.shape[1])
            at = b + hash_uniform(keys, seed + 7919, 1) * (x - b)
            yield pd.DataFrame({"key": keys, "phi": list((x - b) * gradient(at))})

    return drawn.mapInPandas(run, "key bigint, phi array<double>")
