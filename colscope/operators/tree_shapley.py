"""Exact Shapley values of tree ensembles, from the paths to their leaves.

The value of a coalition is the tree's mean where absent columns follow both branches by their training rows. A leaf's share of a column's value then needs only the columns
on its path: with z the part of the training rows that a column's conditions let through and o = 1 where the row meets them, it is
value * (o_j - z_j) * integral over t in (0, 1) of the product over the other columns of o t + z (1 - t).
That integrand is a polynomial of degree m - 1 for m columns, so Gauss-Legendre with ceil(m / 2) points gives it exactly. Leaves with the same number of columns are worked
on together in arrays; the cost follows leaves and depth, whatever the number of columns, and rows are independent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .boosting import AdaBoosted, Boosted, Forest
from .matrix import map_rows
from .trees import Tree

CELLS = 1 << 20  # numbers of one block of rows and leaves


@dataclass
class Paths:
    """Leaves with the same number of columns on their path: column, interval (low, high], share of training rows, and value."""

    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def leaf_paths(trees: list[Tree]) -> tuple[list[Paths], float]:
    """Paths of all leaves and the sum of the trees' means."""
    found: dict[int, list[tuple]] = {}
    mean = 0.0
    for t in trees:
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            node, on = stack.pop()
            f = int(t.feature[node])
            if f < 0:
                names = sorted(on)
                found.setdefault(len(on), []).append((names, [on[c] for c in names], t.value[node]))
                mean += t.value[node] * (t.cover[node] / t.cover[0] if t.cover[0] else 1.0)
                continue
            low, high, share = on.get(f, (-np.inf, np.inf, 1.0))
            cut = float(t.threshold[node])
            for child, own in ((t.left[node], (low, min(high, cut))), (t.right[node], (max(low, cut), high))):
                if t.cover[child] > 0:
                    stack.append((int(child), on | {f: (*own, share * t.cover[child] / t.cover[node])}))
    out = []
    for m, leaves in found.items():
        if m:
            part = np.array([p for _, p, _ in leaves], float).reshape(len(leaves), m, 3)
            out.append(Paths(np.array([c for c, _, _ in leaves]), part[:, :, 0], part[:, :, 1], part[:, :, 2], np.array([v for _, _, v in leaves])))
    return out, mean


def path_values(x: np.ndarray, paths: list[Paths], d: int) -> np.ndarray:
    """Shapley values [rows, columns]."""
    phi = np.zeros((len(x), d))
    for p in paths:
        leaves, m = p.column.shape
        nodes, weights = np.polynomial.legendre.leggauss(-(-m // 2))
        some = max(1, CELLS // m)
        for a in range(0, leaves, some):
            column, low, high, share, value = (v[a:a + some] for v in (p.column, p.low, p.high, p.share, p.value))
            to = np.zeros((column.size, d))
            to[np.arange(column.size), column.ravel()] = 1
            step = max(1, CELLS // column.size)
            for b in range(0, len(x), step):
                own = x[b:b + step][:, column]
                meets = ((own > low) & (own <= high)).astype(float)
                total = np.zeros_like(meets)
                for t, w in zip((nodes + 1) / 2, weights / 2):
                    f = meets * t + share * (1 - t)
                    total += w * f.prod(axis=2, keepdims=True) / f
                got = total * (meets - share) * value[:, None]
                phi[b:b + step] += got.reshape(len(own), -1) @ to
    return phi


def _scaled(tree: Tree, times: float) -> Tree:
    return Tree(tree.feature, tree.cut, tree.threshold, tree.left, tree.right, tree.value * times, tree.cover)


def trees_of(model, spark=None, output: int = 0) -> tuple[list[Tree], float]:
    """Trees whose sum, with a constant, is the model's output: the score of class ``output`` of a boosted model, the mean of a forest, the probability of a class of a classifying forest."""
    if isinstance(model, Boosted):
        return [round_[output] for round_ in model.trees], float(model.start[output])
    if isinstance(model, Forest):
        return [_scaled(t, 1 / len(model.trees)) for t in model.trees], 0.0
    if isinstance(model, AdaBoosted):
        raise ValueError("a weighted median is no sum of trees")
    return _stored_trees(model, spark, output), 0.0


def _stored_trees(model, spark, output: int) -> list[Tree]:
    """Trees of a Spark ML model as it stores them."""
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
    else:
        rows = rows.select(F.lit(0).alias("treeID"), "*")
    weights = list(getattr(model, "treeWeights", [1.0]))
    classes = hasattr(model, "numClasses") and model.numClasses
    nodes: dict[int, list] = {}
    for r in rows.orderBy("treeID", "id").collect():
        nodes.setdefault(int(r["treeID"]), []).append(r)
    total = sum(weights) if "Forest" in type(model).__name__ else 1.0
    out = []
    for tid, own in sorted(nodes.items()):
        stats = np.array([r["impurityStats"] for r in own], float)
        cover = stats.sum(axis=1) if classes else stats[:, 0]
        value = stats[:, output] / np.maximum(cover, 1e-300) if classes else np.array([r["prediction"] for r in own], float)
        inner = np.array([r["leftChild"] >= 0 for r in own])
        feature = np.array([r["split"]["featureIndex"] if i else -1 for r, i in zip(own, inner)])
        threshold = np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for r, i in zip(own, inner)])
        left, right = (np.array([r[c] for r in own]) for c in ("leftChild", "rightChild"))
        out.append(Tree(feature, np.zeros(len(own), int), threshold, left, right, value * weights[tid] / total, cover))
    return out


def tree_shapley(rows: DataFrame, model, output: int = 0) -> tuple[DataFrame, float]:
    """``key, phi ARRAY`` of every row ``key, x``, and the mean that the values add up from: phi sums to the model's output minus it."""
    trees, constant = trees_of(model, rows.sparkSession, output)
    paths, mean = leaf_paths(trees)
    d = len(rows.select("x").first()["x"])
    got = map_rows(rows.select("key", "x"), lambda x: path_values(x, paths, d), "phi").select("key", "phi")
    return got, mean + constant
