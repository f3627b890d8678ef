"""Distance correlation over all rows.

For single columns the double sum of products of distances is computed in n log n. Ordered by x, a
pair's product of distances equals its product of differences up to sign, so it is enough to sum
(x_i - x_j)(y_i - y_j) over the concordant pairs. The plane is cut in strips along both axes: pairs in
different strips of both axes follow from a table of cell sums, the rest lie within one strip. A value
that alone fills a strip needs no work there, as its distances are zero, so a hot value does no harm.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut
from .neighbors import distances
from .pairs import pair_sums

STRIP_ROWS = 200_000
MAX_STRIPS = 400


def concordant(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of (x_i - x_j)(y_i - y_j) over pairs with x_j < x_i and y_j < y_i, by merging halves."""
    n = len(x)
    if n < 2:
        return 0.0
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    at, total, size = np.arange(n), 0.0, 1
    while size < n:
        pair = at // (2 * size)
        o = np.argsort(pair * n + rank, kind="stable")
        left = (o // size) % 2 == 0
        xs, ys = x[o], y[o]
        cols = np.vstack([left, left * xs, left * ys, left * xs * ys])
        run = np.cumsum(cols, axis=1)
        start = np.minimum(pair[o] * 2 * size, n - 1)
        run = run - (run - cols)[:, start]
        r = ~left
        total += float(np.sum(xs[r] * ys[r] * run[0, r] - xs[r] * run[2, r] - ys[r] * run[1, r] + run[3, r]))
        size *= 2
    return total


def mean_distances(v: np.ndarray, n: int, total: float, before_n: float = 0.0, before_s: float = 0.0) -> np.ndarray:
    """Mean absolute distance of each value to all n values, given count and sum of those below this strip."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    c = before_n + np.arange(1, len(s) + 1)
    cs = before_s + np.cumsum(s)
    out = np.empty(len(v))
    out[order] = (s * (2 * c - n) + total - 2 * cs) / n
    return out


def _finish(n, cross, ma, mb, mab, maa, mbb, vx, vy) -> Column:
    """dcor from mean products and mean row means; the squared distances have a closed form."""
    xy = cross / (n * n) + ma * mb - 2 * mab
    xx = 2 * vx + ma * ma - 2 * maa
    yy = 2 * vy + mb * mb - 2 * mbb
    safe = (xx > 1e-14 * vx) & (yy > 1e-14 * vy) & (vx > 0) & (vy > 0)
    return F.when(safe, F.sqrt(F.greatest(xy, F.lit(0.0)) / F.sqrt(xx * yy))).otherwise(0.0)


SUMMARY = "gid int, n double, conc double, sab double, saa double, sbb double, sa double, sb double"


def _whole_group(f: pd.DataFrame) -> pd.DataFrame:
    x, y = f["x"].to_numpy(), f["y"].to_numpy()
    n = len(x)
    a, b = mean_distances(x, n, x.sum()), mean_distances(y, n, y.sum())
    return pd.DataFrame({"gid": [f["gid"].iloc[0]], "n": [float(n)], "conc": [concordant(x, y)], "sab": [a @ b],
                         "saa": [a @ a], "sbb": [b @ b], "sa": [a.sum()], "sb": [b.sum()]})


def _strip_summary(rows: DataFrame, stats: DataFrame, strip_rows: int) -> DataFrame:
    """The sums of :func:`_whole_group` for groups too large for one task."""
    probs = [i / MAX_STRIPS for i in range(1, MAX_STRIPS)]
    ends = rows.groupBy("gid").agg(F.count("*").alias("n"), *[
        F.percentile_approx(v, F.lit(probs), 4 * MAX_STRIPS).alias(f"q{v}") for v in ("x", "y")])
    step = F.greatest(F.lit(1), F.floor(MAX_STRIPS / F.ceil(F.col("n") / strip_rows)).cast("int"))
    thin = lambda q: F.array_distinct(F.filter(F.col(q), lambda v, i: (i + 1) % step == 0))
    ends = ends.select("gid", thin("qx").alias("ex"), thin("qy").alias("ey"))
    # even codes are open strips, odd codes a single value
    code = lambda v, e: 2 * F.size(F.filter(e, lambda b: b < F.col(v))) + F.array_contains(e, F.col(v)).cast("int")
    rows = cut(rows.join(ends, "gid").select("gid", "key", "x", "y", code("x", F.col("ex")).alias("p"),
                                             code("y", F.col("ey")).alias("q")), "strips")
    cells = rows.groupBy("gid", "p", "q").agg(
        F.count("*").cast("double").alias("c"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"))

    def across(f):
        # at most (2 * MAX_STRIPS)^2 cells
        grid = np.zeros((4, f["p"].max() + 2, f["q"].max() + 2))
        for i, c in enumerate(["c", "sx", "sy", "sxy"]):
            grid[i, f["p"] + 1, f["q"] + 1] = f[c]
        below = grid.cumsum(axis=1).cumsum(axis=2)[:, f["p"], f["q"]]
        t = (f["sxy"] * below[0] - f["sx"] * below[2] - f["sy"] * below[1] + f["c"] * below[3]).sum()
        return pd.DataFrame({"gid": [f["gid"].iloc[0]], "t": [t]})

    far = cells.groupBy("gid").applyInPandas(across, "gid int, t double")
    axes = rows.select("gid", "key", F.inline(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("p").alias("code"), F.col("x").alias("v"), F.col("y").alias("u"), F.lit(-1).alias("cell")),
        F.struct(F.lit("y").alias("axis"), F.col("q").alias("code"), F.col("y").alias("v"), F.col("x").alias("u"), F.col("p").alias("cell")))))
    w = W.partitionBy("gid", "axis").orderBy("code")
    strips = (axes.groupBy("gid", "axis", "code").agg(F.count("*").alias("cn"), F.sum("v").alias("cs"))
              .select("gid", "axis", "code", (F.sum("cn").over(w)).alias("upto_n"), F.sum("cs").over(w).alias("upto_s"), "cn", "cs",
                      F.sum("cn").over(W.partitionBy("gid", "axis")).alias("n"), F.sum("cs").over(W.partitionBy("gid", "axis")).alias("total")))
    axes = axes.join(strips, ["gid", "axis", "code"])

    def within(f):
        v, u, first = f["v"].to_numpy(), f["u"].to_numpy(), f.iloc[0]
        m = mean_distances(v, first["n"], first["total"], first["upto_n"] - first["cn"], first["upto_s"] - first["cs"])
        t = concordant(v, u)
        if first["axis"] == "y":
            # pairs of the same strip of x are counted there
            t -= sum(concordant(g["v"].to_numpy(), g["u"].to_numpy()) for _, g in f.groupby("cell"))
        ts = np.zeros(len(f))
        ts[0] = t
        return pd.DataFrame({"gid": f["gid"], "key": f["key"], "axis": f["axis"], "m": m, "t": ts})

    odd = F.col("code") % 2 == 1
    v = F.col("v")
    single = axes.where(odd).select("gid", "key", "axis", (
        (v * (2 * F.col("upto_n") - F.col("n")) + F.col("total") - 2 * F.col("upto_s")) / F.col("n")).alias("m"), F.lit(0.0).alias("t"))
    near = axes.where(~odd).groupBy("gid", "axis", "code").applyInPandas(
        within, "gid int, key bigint, axis string, m double, t double").unionByName(single)
    per_row = near.groupBy("gid", "key").agg(
        F.max(F.when(F.col("axis") == "x", F.col("m"))).alias("a"), F.max(F.when(F.col("axis") == "y", F.col("m"))).alias("b"),
        F.sum("t").alias("t"))
    a, b = F.col("a"), F.col("b")
    return (per_row.groupBy("gid").agg(
        F.count("*").cast("double").alias("n"), F.sum("t").alias("near"), F.sum(a * b).alias("sab"), F.sum(a * a).alias("saa"),
        F.sum(b * b).alias("sbb"), F.sum(a).alias("sa"), F.sum(b).alias("sb"))
        .join(far, "gid").withColumn("conc", F.col("near") + F.col("t")).select(*[c.split()[0] for c in SUMMARY.split(", ")]))


def distance_correlation(rows: DataFrame, strip_rows: int = STRIP_ROWS, stored: bool = False) -> DataFrame:
    """``gid, dcor`` from rows ``gid int, key bigint, x double, y double``; keys are unique per group.

    ``stored`` says that the rows come straight from a table and are cheap to read again.
    """
    rows = (rows.select(F.col("gid").cast("int"), F.col("key").cast("long"), F.col("x").cast("double"), F.col("y").cast("double"))
               .where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    rows = rows if stored else cut(rows, "dcor")
    x, y = F.col("x"), F.col("y")
    stats = cut(rows.groupBy("gid").agg(F.count("*").alias("rows"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                                        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy")), "dcor_stats")
    centred = rows.join(stats, "gid").select("gid", "key", (x - F.col("mx")).alias("x"), (y - F.col("my")).alias("y"), "rows")
    summary = (centred.where(F.col("rows") <= strip_rows).drop("rows").groupBy("gid").applyInPandas(_whole_group, SUMMARY))
    if stats.where(F.col("rows") > strip_rows).limit(1).count():
        summary = summary.unionByName(_strip_summary(centred.where(F.col("rows") > strip_rows).drop("rows"), stats, strip_rows))
    n = F.col("n")
    # all ordered pairs of differences sum to 2 n^2 cov; concordant ones count twice, the rest negative
    cross = 4 * F.col("conc") - 2 * n * n * F.col("cxy")
    means = {c: F.col(f"s{c}") / n for c in ("a", "b", "ab", "aa", "bb")}
    return summary.join(stats, "gid").select("gid", _finish(
        n, cross, means["a"], means["b"], means["ab"], means["aa"], means["bb"], F.col("vx"), F.col("vy")).alias("dcor"))


def distance_correlation_blocks(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``gid, dcor`` for rows ``gid, key, x ARRAY, y ARRAY``: Euclidean distances over several columns."""
    rows = cut(rows.select("gid", "key", "x", "y"), "dcor_blocks")
    rows = rows.join(rows.groupBy("gid").agg(F.count("*").alias("n")), "gid")

    def sums(a, b):
        dx, dy = distances(a["x"], b["x"]), distances(a["y"], b["y"])
        return {"a": dx.sum(1), "b": dy.sum(1), "ab": (dx * dy).sum(1), "aa": (dx * dx).sum(1), "bb": (dy * dy).sum(1)}

    per = pair_sums(rows, sums, ["a", "b", "ab", "aa", "bb"], "n", gid="gid", block_rows=block_rows)
    n = F.count("*")
    a, b = F.col("a"), F.col("b")

    def v(prod, l, r):
        return F.sum(prod) / (n * n) + F.sum(l) * F.sum(r) / (n * n * n * n) - 2 * F.sum(l * r) / (n * n * n)

    agg = per.groupBy("gid").agg(v(F.col("ab"), a, b).alias("xy"), v(F.col("aa"), a, a).alias("xx"), v(F.col("bb"), b, b).alias("yy"))
    safe = (F.col("xx") > 1e-15) & (F.col("yy") > 1e-15)
    return agg.select("gid", F.when(safe, F.sqrt(F.greatest(F.col("xy"), F.lit(0.0)) / F.sqrt(F.col("xx") * F.col("yy")))).otherwise(0.0).alias("dcor"))
