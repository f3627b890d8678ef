"""Exact k-nearest-neighbour join as Spark shuffles.

The base rows are cut in two levels. The coarse cells are the leaves of a k-d tree (intervals, for one input) that the driver grows from a sample of bounded
size. A query row first meets its own cell alone. What it finds there bounds the distance to its true neighbours; only a query whose ball crosses the cell's border
goes on, to those cells that the ball touches, and the lists are put together.

In a cell the task makes the finer cuts itself: with one input rows are sorted and each query sees as many rows to its left and right as can win, with more
they are cut into leaves of some dozens of rows, and a query sees the leaves within the bound its own leaf gave. So the pairs compared per query do
not follow the size of a cell, and few cells are enough, however many groups share the sample.

Base rows with equal coordinates are first reduced to the k that can win a tie. Queries of a cell with very many of them are dealt over copies of the cell,
and a cell that came out very large is cut in sub-blocks, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import cut

CELL = 8192         # base rows per coarse cell aimed at while the sample is large enough to cut that finely
LEAF = 64           # base rows per leaf inside a task
WIDE = 8            # columns from which products of matrices sort out the pairs of a task
WIDE_QUERIES = 256  # queries that share such a product
WIDE_SLACK = 8      # times the columns and the last digit's worth: more than the squares from the product can be off
BLOCK = 1 << 20     # base rows per sub-block of a cell that came out larger
QUERY_BLOCK = 50_000
CELLS = 128         # per group, before cells grow: the fewer borders, the fewer queries that go on to other cells
GROWN = 8           # times CELL at most, and for narrow rows alone
ENTRIES = 1 << 20   # entries of lists that a task puts together at once
PER_CELL = 16       # sample rows that a coarse cell rests on
SAMPLE_SHARE = 0.5  # of the base, up to the total below over all groups
SAMPLE_VALUES = 1 << 19  # coordinates in all samples together: what the driver and each task hold
MAX_DEPTH = 16
NEAR = pa.list_(pa.struct([("d", pa.float64()), ("key", pa.int64()), ("part", pa.int32()), ("y", pa.list_(pa.float64()))]))
NN_TYPE = "array<struct<d:double,key:bigint,part:int,y:array<double>>>"


@dataclass
class Tree:
    """A complete binary tree of axis cuts; nodes in heap order, the last level being the cells."""

    dim: np.ndarray
    cutv: np.ndarray
    depth: int
    lo: np.ndarray        # corners of every node's box
    hi: np.ndarray
    subs: np.ndarray      # base sub-blocks per cell
    salts: np.ndarray     # query sub-blocks per cell
    sample: np.ndarray
    parts: np.ndarray     # of the sample rows
    n_parts: int


def _grow(x: np.ndarray, depth: int, d: int):
    inner, nodes = (1 << depth) - 1, (1 << (depth + 1)) - 1
    dim, cutv = np.zeros(max(inner, 1), dtype=int), np.full(max(inner, 1), np.inf)
    lo, hi = np.full((nodes, d), -np.inf), np.full((nodes, d), np.inf)
    rows = {0: np.arange(len(x))}
    for node in range(inner):
        mine = rows.pop(node)
        pts = x[mine]
        j = int(np.argmax(np.ptp(pts, axis=0))) if len(pts) else 0
        v = float(np.median(pts[:, j])) if len(pts) else 0.0
        dim[node], cutv[node] = j, v
        a, b = 2 * node + 1, 2 * node + 2
        lo[a], hi[a], lo[b], hi[b] = lo[node], hi[node], lo[node], hi[node]
        hi[a, j], lo[b, j] = min(hi[node, j], v), max(lo[node, j], v)
        left = pts[:, j] < v if len(pts) else np.zeros(0, bool)
        rows[a], rows[b] = mine[left], mine[~left]
    return dim, cutv, lo, hi


def _descend(t: Tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=int)
    for _ in range(t.depth):
        node = 2 * node + 1 + (x[np.arange(len(x)), t.dim[node]] >= t.cutv[node])
    return node - ((1 << t.depth) - 1)


def distances(a: np.ndarray, b: np.ndarray, p: int = 2) -> np.ndarray:
    """Distances between the rows of two blocks, summed column by column."""
    out, diff = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for j in range(a.shape[1]):
        np.subtract(a[:, j, None], b[None, :, j], out=diff)
        out += np.abs(diff, out=diff) if p == 1 else np.multiply(diff, diff, out=diff)
    return out if p == 1 else np.sqrt(out, out=out)


def block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of wide rows by a product of matrices, for sums over pairs; where its digits would cancel, from the differences themselves."""
    if a.shape[1] < 8 or not (len(a) and len(b)):
        return distances(a, b)
    middle = b.mean(axis=0)
    u, v = a - middle, b - middle
    size = (u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)
    if not np.isfinite(size).all():
        return distances(a, b)
    out = size - 2 * (u @ v.T)
    i, j = np.nonzero(out < 1e-4 * size)
    if len(i) > out.size // 8:
        return distances(a, b)
    out[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(out, 0.0))


def _reached(t: Tree, x: np.ndarray, r: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) pairs whose box lies within the row's bound, found level by level from the root."""
    i, node = np.arange(len(x)), np.zeros(len(x), dtype=int)
    for _ in range(t.depth):
        i, node = np.repeat(i, 2), np.repeat(2 * node + 1, 2)
        node[1::2] += 1
        gap = np.maximum(np.maximum(t.lo[node] - x[i], x[i] - t.hi[node]), 0.0)
        near = (gap.sum(axis=1) if p == 1 else np.sqrt((gap * gap).sum(axis=1))) <= r[i]
        i, node = i[near], node[near]
    return i, node - ((1 << t.depth) - 1)


def _bounds(t: Tree, x: np.ndarray, k: int, p: int) -> np.ndarray:
    """Upper bound of the distance to the k-th neighbour of every part by the sample; without k rows of a part in it there is none."""
    r = np.full(len(x), np.inf)
    if len(t.parts) and np.bincount(t.parts, minlength=t.n_parts)[:t.n_parts].min() >= k:
        for a in range(0, len(x), 512):
            d = distances(x[a:a + 512], t.sample, p)
            r[a:a + 512] = np.max([np.partition(d[:, t.parts == q], k - 1, axis=1)[:, k - 1] for q in range(t.n_parts)], axis=0)
    return r * (1 + 1e-12)


def _plan(base: DataFrame, queries: DataFrame, d: int, k: int) -> dict[int, Tree]:
    both = base.select("gid", F.lit(1).alias("b"), "part").unionByName(queries.select("gid", F.lit(0).alias("b"), F.lit(0).alias("part")))
    sizes = both.groupBy("gid", "b").agg(F.count("*").alias("n"), (F.max("part") + 1).alias("parts")).collect()
    nb, np_ = {r["gid"]: r["n"] for r in sizes if r["b"]}, {r["gid"]: r["parts"] for r in sizes if r["b"]}
    nq = {r["gid"]: r["n"] for r in sizes if not r["b"]}
    most = max(SAMPLE_VALUES // max(len(nb) * d, 1), PER_CELL)

    def sampled(df, counts, seed):
        big = {g: min(SAMPLE_SHARE, most / n, max(PER_CELL * nb[g] / CELL, 1000) / n) for g, n in counts.items() if nb.get(g, 0) > 2 * CELL}
        if not big:
            return {}
        share = F.create_map(*[F.lit(x) for kv in big.items() for x in kv])[F.col("gid")]
        unit = F.pmod(F.xxhash64(F.lit(seed), "gid", "key"), F.lit(1 << 30)) / float(1 << 30)
        rows = df.where(unit < share).select("gid", "x", *(["part"] if "part" in df.columns else [])).collect()
        out: dict = {}
        for r in rows:
            out.setdefault(r["gid"], []).append(r)
        return out

    sb, sq = sampled(base, nb, 11), sampled(queries, nq, 13)
    plan = {}
    for g, n in nb.items():
        rows = sb.get(g, [])
        x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, d)
        parts = np.array([r["part"] for r in rows], dtype=int)
        depth = int(np.clip(np.floor(np.log2(max(min(n / (CELL if d >= WIDE else np.clip(n / CELLS, CELL, GROWN * CELL)), len(x) / PER_CELL), 1))), 0, MAX_DEPTH))
        dim, cutv, lo, hi = _grow(x, depth, d)
        ones = np.ones(1 << depth, int)
        t = Tree(dim, cutv, depth, lo, hi, ones, ones, x, parts, np_[g])

        def share(pts):
            if not len(pts):
                return np.full(1 << depth, 1.0 / (1 << depth))
            return np.bincount(_descend(t, pts), minlength=1 << depth) / len(pts)

        t.subs = np.maximum(np.ceil(share(x) * n / BLOCK).astype(int), 1)
        q = np.array([r["x"] for r in sq.get(g, [])], dtype=float).reshape(-1, d)
        t.salts = np.maximum(np.ceil(share(q) * nq.get(g, 0) / QUERY_BLOCK).astype(int), 1)
        plan[g] = t
    return plan


def _first(dist: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k least distances, in order; ties by ``key`` (given per column or per cell), infinite ones left out."""
    k = min(k, dist.shape[1])
    kth = np.partition(dist, k - 1, axis=1)[:, k - 1]
    i, j = np.nonzero((dist <= kth[:, None]) & np.isfinite(dist))
    ties = key[j] if key.ndim == 1 else key[i, j]
    order = np.lexsort((ties, dist[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(dist)))[i] < k
    return i[keep], j[keep]


def _in_line(qx: np.ndarray, bx: np.ndarray, bkey: np.ndarray, k: int):
    """One input: rows in order, each query against as many on either side as can be among the k (equal values may share a place)."""
    order = np.lexsort((bkey, bx))
    line, keys = bx[order], bkey[order]
    edges = np.flatnonzero(np.r_[True, line[1:] != line[:-1], True])
    width = k + int(np.diff(edges).max())
    reach = np.arange(-width, width)
    for a in range(0, len(qx), 16_384):
        q = qx[a:a + 16_384]
        at = np.searchsorted(line, q)[:, None] + reach
        inside = (at >= 0) & (at < len(line))
        at = np.clip(at, 0, len(line) - 1)
        dist = np.where(inside, np.abs(q[:, None] - line[at]), np.inf)
        i, j = _first(dist, keys[at], k)
        yield a + i, dist[i, j], order[at[i, j]], int(inside.sum())


def _leaves(bx: np.ndarray, qx: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(base rows, query rows) of the leaves of a tree of median cuts over the base; the boxes of the leaves are those of their rows."""
    stack, out = [(np.arange(len(bx)), np.arange(len(qx)))], []
    while stack:
        b, q = stack.pop()
        wide = np.ptp(bx[b], axis=0)
        j = int(wide.argmax())
        if len(b) <= size or wide[j] == 0:
            out.append((b, q))
            continue
        half = len(b) // 2
        order = np.argpartition(bx[b, j], half)
        left = qx[q, j] < bx[b[order[half]], j]
        stack += [(b[order[:half]], q[left]), (b[order[half:]], q[~left])]
    return out


def _in_leaves(qx: np.ndarray, bx: np.ndarray, bkey: np.ndarray, k: int, p: int):
    leaves = _leaves(bx, qx, max(LEAF, 2 * k))
    starts = np.cumsum([0] + [len(b) for b, _ in leaves])
    rows = np.concatenate([b for b, _ in leaves])
    lo, hi = (np.array([f(bx[b], axis=0) for b, _ in leaves]) for f in (np.min, np.max))
    for b, queries in leaves:
        for a in range(0, len(queries), LEAF):
            mine = queries[a:a + LEAF]
            q = qx[mine]
            own = distances(q, bx[b], p)
            each = np.partition(own, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1] * (1 + 1e-12) if len(b) >= k else np.full(len(q), np.inf)
            r = each.max()
            gap = np.maximum(np.maximum(lo - q.max(axis=0), q.min(axis=0) - hi), 0.0)
            near = np.flatnonzero((gap.sum(axis=1) if p == 1 else np.sqrt((gap * gap).sum(axis=1))) <= r)
            some = np.concatenate([rows[starts[n]:starts[n + 1]] for n in near])
            step = max(1, (1 << 21) // len(some))
            for c in range(0, len(q), step):
                if np.isfinite(r) and p == 2:  # only what lies within a query's bound is sorted
                    i, j, dist = _within(q[c:c + step], bx[some], bkey[some], each[c:c + step], k)
                    yield mine[c + i], dist, some[j], len(q[c:c + step]) * len(some) + own.size
                    continue
                dist = distances(q[c:c + step], bx[some], p)
                i, j = _first(dist, bkey[some], k)
                yield mine[c + i], dist[i, j], some[j], dist.size + own.size


def _within(q: np.ndarray, x: np.ndarray, key: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of each row's k nearest, in the order of :func:`_first`; ``r`` is a bound of the k-th distance of each row."""
    square, diff = np.subtract(q[:, 0, None], x[None, :, 0]), np.empty((len(q), len(x)))
    np.multiply(square, square, out=square)
    for c in range(1, q.shape[1]):
        np.subtract(q[:, c, None], x[None, :, c], out=diff)
        square += np.multiply(diff, diff, out=diff)
    # a little more than the bound, whose own square may be rounded down
    at = np.flatnonzero(square <= (r * r * (1 + 1e-12) + 1e-300)[:, None])
    i, j = np.divmod(at, len(x))
    dist = np.sqrt(square.ravel()[at])
    order = np.lexsort((key[j], dist, i))
    i, j, dist = i[order], j[order], dist[order]
    keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < k
    return i[keep], j[keep], dist[keep]


def _in_wide_leaves(qx: np.ndarray, bx: np.ndarray, bkey: np.ndarray, k: int):
    """As :func:`_in_leaves` by the Euclidean distance, for rows of many columns: few leaves can be left out, so queries of leaves that lie together meet a block in one
    product of matrices. It gives the squares of all distances but for last digits; the few that can be among the k are computed as :func:`distances` does."""
    leaves = _leaves(bx, qx, max(LEAF, 2 * k))
    starts = np.cumsum([0] + [len(b) for b, _ in leaves])
    rows = np.concatenate([b for b, _ in leaves])
    lo, hi = (np.array([f(bx[b], axis=0) for b, _ in leaves]) for f in (np.min, np.max))
    base, keys, d = bx[rows], bkey[rows], bx.shape[1]
    middle = base.mean(axis=0)
    v = base - middle
    vv = (v * v).sum(axis=1)
    queries, home = np.concatenate([q for _, q in leaves]), np.repeat(np.arange(len(leaves)), [len(q) for _, q in leaves])
    for a in range(0, len(queries), WIDE_QUERIES):
        mine, leaf = queries[a:a + WIDE_QUERIES], home[a:a + WIDE_QUERIES]
        q, r, compared = qx[mine], 0.0, 0
        for n in np.unique(leaf):
            size = len(leaves[n][0])
            own = distances(q[leaf == n], bx[leaves[n][0]])
            compared += own.size
            r = np.maximum(r, np.partition(own, k - 1, axis=1)[:, k - 1].max() * (1 + 1e-12) if size >= k else np.inf)
        gap = np.maximum(np.maximum(lo - q.max(axis=0), q.min(axis=0) - hi), 0.0)
        near = np.flatnonzero(~(np.sqrt((gap * gap).sum(axis=1)) > r))
        at = slice(None) if len(near) == len(leaves) else np.concatenate([np.arange(starts[n], starts[n + 1]) for n in near])
        some, key, w, ww = base[at], keys[at], v[at], vv[at]
        step = max(1, min(len(q), (1 << 19) // len(some)))
        for c in range(0, len(q), step):
            x = q[c:c + step]
            i, j, dist = _first_wide(x, x - middle, some, w, ww, key, k)
            yield mine[c + i], dist, rows[at][j], len(x) * len(some) + compared
            compared = 0


def _first_wide(x: np.ndarray, u: np.ndarray, some: np.ndarray, w: np.ndarray, ww: np.ndarray, key: np.ndarray, k: int):
    """Row, column and distance of each row's k nearest, in the order of :func:`_first`; ``u`` and ``w`` are the rows about a common middle, ``ww`` the squares of ``w``."""
    if len(some) > 4 * k:
        off = WIDE_SLACK * (x.shape[1] + 8) * np.finfo(float).eps * ((u * u).sum(axis=1) + ww.max())
        square = (-2 * u) @ w.T
        square += ww
        if np.isfinite(off).all():
            i, j = divmod(np.flatnonzero(square <= (np.partition(square, k - 1, axis=1)[:, k - 1] + off)[:, None]), len(some))
            if len(i) <= square.size // 8:
                dist = np.zeros(len(i))
                for c in range(x.shape[1]):
                    diff = x[i, c] - some[j, c]
                    dist += diff * diff
                dist = np.sqrt(dist)
                order = np.lexsort((key[j], dist, i))
                i, j, dist = i[order], j[order], dist[order]
                keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(x)))[i] < k
                return i[keep], j[keep], dist[keep]
    dist = distances(x, some)
    i, j = _first(dist, key, k)
    return i, j, dist[i, j]


def local_nearest(qx: np.ndarray, bx: np.ndarray, bkey: np.ndarray, bpart: np.ndarray, k: int, p: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k nearest base rows of every part for each query: query row, distance, base row in the order of query, distance and key, and the pairs compared."""
    hits, compared = [], 0
    for part in np.unique(bpart):
        mine = np.flatnonzero(bpart == part)
        if bx.shape[1] == 1:
            found = _in_line(qx[:, 0], bx[mine, 0], bkey[mine], k)
        elif bx.shape[1] < WIDE or p != 2:
            found = _in_leaves(qx, bx[mine], bkey[mine], k, p)
        else:
            found = _in_wide_leaves(qx, bx[mine], bkey[mine], k)
        for i, dist, at, n in found:
            hits.append((i, dist, mine[at]))
            compared += n
    row, dist, at = (np.concatenate(v) for v in zip(*hits))
    order = np.lexsort((bkey[at], dist, row))
    return row[order], dist[order], at[order], compared


class Means:
    """Mean targets of the first k of a list, over all parts (``m{k}_{o}``) and with one part left out (``m{k}_{part}_{o}``); weighed by distance as ``w`` in place of ``m``."""

    def __init__(self, ks: list[int], left_out: list[int], outputs: int, weights: tuple[str, ...] = ("uniform",)):
        self.variants = [(("m" if w == "uniform" else "w") + f"{k}" + ("" if f is None else f"_{f}") + f"_{o}", k, f, o, w) for w in weights for k in ks for f in (None, *left_out) for o in range(outputs)]
        self.names = [v[0] for v in self.variants]

    def __call__(self, n: int, row: np.ndarray, dist: np.ndarray, part: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Values for lists given as entries in the order of row and distance; nan where a list has no entry."""
        places: dict = {}
        for f in {v[2] for v in self.variants}:
            own = np.ones(len(row), bool) if f is None else part != f
            at = np.flatnonzero(own)
            places[f] = at, np.arange(len(at)) - np.searchsorted(row[at], row[at])
        out = []
        for _, k, f, o, weights in self.variants:
            at, place = places[f]
            at = at[place < k]
            if weights != "uniform":  # exact hits alone count when there are any
                hit = dist[at] == 0
                exact = np.bincount(row[at], hit, minlength=n)[row[at]] > 0
                wt = np.where(exact, hit, 1 / np.where(hit, 1.0, dist[at]))
                total = np.bincount(row[at], wt, minlength=n)
                out.append(np.where(total > 0, np.bincount(row[at], wt * y[at, o], minlength=n) / np.where(total > 0, total, 1.0), np.nan))
                continue
            count = np.bincount(row[at], minlength=n)
            out.append(np.where(count > 0, np.bincount(row[at], y[at, o], minlength=n) / np.maximum(count, 1), np.nan))
        return out


def _pack(row, dist, key, part, y, n: int) -> pa.Array:
    """Lists of n rows as an Arrow array; entries come in the order of ``row``."""
    o = y.shape[1]
    ys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * o + 1, o, dtype=np.int32)), pa.array(y.ravel()))
    one = pa.StructArray.from_arrays([pa.array(dist), pa.array(key), pa.array(part.astype(np.int32)), ys], fields=list(NEAR.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), one)


def nearest(queries: DataFrame, base: DataFrame, k: int, carry: tuple[str, ...] = (), p: int = 2,
            dims: tuple[int, int] | None = None, stored: bool = False, means: Means | None = None) -> DataFrame:
    """The k nearest base rows of each query row, per group and per part of the base.

    ``queries``: gid int, key long, x array<double>, carried double columns.
    ``base``: gid int, key long, x array<double>, part int, y array<double>.
    Result: gid, key, carried columns, ``nn`` = array of (d, key, part, y) sorted by distance then key, the k nearest of every part.
    With ``means`` their values take the place of the lists, which then never leave the tasks but for rows near a cell's border.
    ``dims`` gives the sizes of x and y where they are known, and ``stored`` says that the queries come straight from a table.
    """
    spark = queries.sparkSession
    base = base.select("gid", "key", "x", "part", "y")
    # equal coordinates: only the k lowest keys can be chosen (the limit is applied before the shuffle)
    w = W.partitionBy("gid", "part", "x").orderBy("key")
    base = cut(base.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r"), "knn_base")
    queries = queries.select("gid", "key", "x", *carry)
    queries = queries if stored else cut(queries, "knn_query")
    d, o = dims or base.select(F.size("x"), F.size("y")).first() or (1, 1)
    plan = _plan(base, queries, d, k)
    names = means.names if means else []
    if not plan:
        empty = T.StructType(queries.select("gid", "key", *carry).schema.fields)
        for c in names:
            empty = empty.add(c, "double")
        return spark.createDataFrame([], empty if means else empty.add("nn", NN_TYPE))
    # the tasks get the trees and samples along with their code: at most SAMPLE_VALUES coordinates altogether
    carry = list(carry)
    xcols, ycols = [f"x{j}" for j in range(d)], [f"ny{j}" for j in range(o)]

    def place_base(frames):
        for f in frames:
            for g, rows in f.groupby("gid", sort=False):
                t = plan[g]
                x = rows[xcols].to_numpy()
                leaf = _descend(t, x)
                reps = t.salts[leaf]
                at = np.repeat(np.arange(len(rows)), reps)
                out = {"gid": g, "cell": leaf[at], "sub": (rows["h"].to_numpy() % t.subs[leaf])[at], "salt": np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps),
                       "key": rows["key"].to_numpy()[at], "part": rows["part"].to_numpy()[at]}
                y = rows[ycols].to_numpy()
                yield pd.DataFrame(out | {c: x[at, j] for j, c in enumerate(xcols)} | {c: y[at, j] for j, c in enumerate(ycols)})

    def place_home(frames):
        for f in frames:
            for g, rows in f.groupby("gid", sort=False):
                t = plan.get(g)
                if t is not None:
                    x, h = rows[xcols].to_numpy(), rows["h"].to_numpy()
                    leaf = _descend(t, x)
                    out = {"gid": g, "cell": leaf, "sub": h % t.subs[leaf], "salt": h // 64 % t.salts[leaf], "key": rows["key"].to_numpy()}
                    yield pd.DataFrame(out | {c: x[:, j] for j, c in enumerate(xcols)} | {c: rows[c].to_numpy(dtype=float) for c in carry})

    def place_far(frames):
        for f in frames:
            for g, rows in f.groupby("gid", sort=False):
                t = plan[g]
                for a in range(0, len(rows), 10_000):
                    part = rows.iloc[a:a + 10_000]
                    x, h, r = part[xcols].to_numpy(), part["h"].to_numpy(), part["r"].to_numpy(dtype=float)
                    open_ = np.flatnonzero(~np.isfinite(r))
                    if len(open_):
                        r = r.copy()
                        r[open_] = _bounds(t, x[open_], k, p)
                    i, leaf = _reached(t, x, r, p)
                    at = np.repeat(np.arange(len(i)), t.subs[leaf])
                    sub = np.arange(len(at)) - np.repeat(np.cumsum(t.subs[leaf]) - t.subs[leaf], t.subs[leaf])
                    i, leaf = i[at], leaf[at]
                    home = _descend(t, x)[i]
                    go = (leaf != home) | (sub != h[i] % t.subs[home])
                    i, leaf, sub = i[go], leaf[go], sub[go]
                    out = {"gid": g, "cell": leaf, "sub": sub, "salt": h[i] // 64 % t.salts[leaf], "key": part["key"].to_numpy()[i]}
                    yield pd.DataFrame(out | {c: x[i, j] for j, c in enumerate(xcols)} | {c: part[c].to_numpy(dtype=float)[i] for c in carry})

    xs, ys = ", ".join(f"{c} double" for c in xcols), ", ".join(f"{c} double" for c in ycols)
    cs = "".join(f", {c} double" for c in carry)
    ms = "".join(f", {c} double" for c in names)
    ids = "gid int, cell int, sub int, salt int, key bigint"
    h = F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(1 << 30)).alias("h")
    # single columns reach the tasks as blocks of numbers, arrays as one object a row
    flat = [F.col("x")[j].alias(c) for j, c in enumerate(xcols)]
    right = base.select("gid", "key", "part", *flat, *[F.col("y")[j].alias(c) for j, c in enumerate(ycols)], h).mapInPandas(place_base, f"{ids}, part int, {xs}, {ys}")
    outer = ["gid", "key", *carry]

    def matrix(t, cols):
        return np.column_stack([t.column(c).to_numpy() for c in cols])

    def values(n, row, dist, part, y):
        return {c: pa.array(v, from_pandas=True) for c, v in zip(names, means(n, row, dist, part, y))} if means else {}

    def lists(q, b):
        """Entries of the queries' lists, and the lists of the rows where ``some``."""
        bkey, bpart, by, qx = b.column("key").to_numpy(), b.column("part").to_numpy(), matrix(b, ycols), matrix(q, xcols)
        row, dist, at, _ = local_nearest(qx, matrix(b, xcols), bkey, bpart, k, p)
        return qx, row, dist, bkey[at], bpart[at], by[at]

    def at_home(keys, q, b):
        n = len(q)
        t = plan[keys[0].as_py()] if n else None
        if not n:
            return pa.table({c: pa.array([], f.type) for c, f in zip(home_schema.names, home_schema)}, schema=home_schema)
        if len(b):
            qx, row, dist, key, part, y = lists(q, b)
        else:
            qx, row, dist, key, part, y = matrix(q, xcols), np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, int), np.zeros((0, o))
        # the ball around a row holds k rows of every part
        r = np.zeros(n)
        for f in range(t.n_parts):
            mine = np.flatnonzero(part == f)
            place = np.arange(len(mine)) - np.searchsorted(row[mine], row[mine])
            last = mine[place == k - 1]
            far = np.full(n, np.inf)
            far[row[last]] = dist[last]
            r = np.maximum(r, far)
        node = (1 << t.depth) - 1 + keys[1].as_py()
        border = np.minimum(qx - t.lo[node], t.hi[node] - qx).min(axis=1)
        r = r * (1 + 1e-12)
        done = (r < border) & (t.subs[keys[1].as_py()] == 1)
        if t.depth == 0 and t.subs[0] == 1:
            done[:] = True
        out = {c: q.column(c) for c in outer} | {"done": pa.array(done), "r": pa.array(r)} | {c: pa.array(qx[:, j]) for j, c in enumerate(xcols)}
        out |= values(n, row, dist, part, y)
        if means:  # lists go on where they are not complete
            go = ~done[row]
            row, dist, key, part, y = row[go], dist[go], key[go], part[go], y[go]
        return pa.table(out | {"near": _pack(row, dist, key, part, y, n)})

    def abroad(q, b):
        if not len(q) or not len(b):
            return pa.table({c: pa.array([], q.schema.field(c).type) for c in outer} | {"near": pa.array([], NEAR)})
        _, *entries = lists(q, b)
        return pa.table({c: q.column(c) for c in outer} | {"near": _pack(*entries, len(q))})

    kinds = {"gid": pa.int32(), "key": pa.int64(), "done": pa.bool_(), "near": NEAR}
    order = [*outer, "done", "r", *xcols, *names, "near"]
    home_schema = pa.schema([(c, kinds.get(c, pa.float64())) for c in order])
    where = ["gid", "cell", "sub", "salt"]
    left = queries.select("gid", "key", *flat, *carry, h).mapInPandas(place_home, f"{ids}, {xs}{cs}")
    home = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(at_home, f"gid int, key bigint{cs}, done boolean, r double, {xs}{ms}, near {NN_TYPE}")
    result = [*outer, *(names or ["nn"])]
    if all(t.depth == 0 and t.subs[0] == 1 for t in plan.values()):
        return home.withColumnRenamed("near", "nn").select(*result)
    home = cut(home, "knn_home")
    ready = home.where("done").withColumnRenamed("near", "nn").select(*result)
    open_ = home.where("NOT done")
    visits = cut(open_.select(*outer, "r", *xcols, h).mapInPandas(place_far, f"{ids}, {xs}{cs}"), "knn_visits")
    asked = visits.select(*where).distinct()  # at most one row per cell and copy
    found = visits.groupBy(*where).cogroup(right.join(asked, where, "left_semi").groupBy(*where)).applyInArrow(abroad, f"gid int, key bigint{cs}, near {NN_TYPE}")
    more = open_.select(*outer, "near").unionByName(found)
    if max(int(t.subs.sum()) for t in plan.values()) > 256:
        # a query may meet very many blocks: drop what cannot be among the k before lists are put together
        w = W.partitionBy("gid", "key", "n.part").orderBy("n.d", "n.key")
        more = more.withColumn("n", F.explode("near")).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
        more = more.select(*outer, F.array("n").alias("near"))
    # lists are put together in blocks of rows, each of a bounded number of entries
    lots = max(1, (visits.count() + open_.count()) * k * max(t.n_parts for t in plan.values()) // ENTRIES)
    last = {c: pa.float64() for c in names} if means else {"nn": NEAR}
    whole_schema = pa.schema([*[(c, kinds.get(c, pa.float64())) for c in outer], *last.items()])

    def together(t):
        """One row per query: of all its lists the first k of each part, in order."""
        if not t.num_rows:
            return whole_schema.empty_table()
        t = t.combine_chunks()
        ids = np.column_stack([t.column("gid").to_numpy().astype(np.int64), t.column("key").fill_null(np.iinfo(np.int64).min).to_numpy()])
        _, first, query = np.unique(ids, axis=0, return_index=True, return_inverse=True)
        near = t.column("near").combine_chunks()
        entries = near.flatten()
        row = np.repeat(query.ravel(), np.asarray(near.value_lengths()))
        dist, key, part = (entries.field(c).to_numpy() for c in ("d", "key", "part"))
        y = entries.field("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, o)
        order = np.lexsort((*y.T[::-1], part, key, dist, row))
        row, dist, key, part, y = row[order], dist[order], key[order], part[order], y[order]
        keep = np.zeros(len(row), bool)
        for f in np.unique(part):
            mine = np.flatnonzero(part == f)
            keep[mine[np.arange(len(mine)) - np.searchsorted(row[mine], row[mine]) < k]] = True
        row, dist, key, part, y = row[keep], dist[keep], key[keep], part[keep], y[keep]
        n = len(first)
        out = {c: t.column(c).take(pa.array(first)) for c in outer}
        return pa.table(out | (values(n, row, dist, part, y) if means else {"nn": _pack(row, dist, key, part, y, n)}))

    lot = F.pmod(F.xxhash64(F.lit(19), "gid", "key"), F.lit(lots)).alias("lot")
    whole = more.select(*outer, "near", lot).repartition(lots, "lot").groupBy("lot").applyInArrow(together, f"gid int, key bigint{cs}" + (ms if means else f", nn {NN_TYPE}"))
    return ready.unionByName(whole.select(*result))


def best_of(nn: str, k: int, but_part: int | None = None) -> str:
    """SQL text: the first k neighbours of a sorted list, one part left out if asked."""
    if but_part is not None:
        nn = f"filter({nn}, n -> n.part != {but_part})"
    return f"slice({nn}, 1, {k})"


def _total(arr: str) -> str:
    return f"aggregate({arr}, 0D, (a, v) -> a + v)"


def mean_of(nn: str, output: int = 0, weights: str = "uniform") -> Column:
    """Mean target of a neighbour list; with distance weights exact hits alone count when there are any."""
    if weights == "uniform":
        return F.expr(f"{_total(f'transform({nn}, n -> n.y[{output}])')} / size({nn})")
    wt = f"if(exists({nn}, m -> m.d = 0D), if(n.d = 0D, 1D, 0D), 1D / n.d)"
    return F.expr(f"{_total(f'transform({nn}, n -> {wt} * n.y[{output}])')} / {_total(f'transform({nn}, n -> {wt})')}")


def vote_of(nn: str, output: int = 0) -> Column:
    """Most frequent label of a neighbour list, the smallest on ties."""
    labels = f"transform({nn}, n -> n.y[{output}])"
    return F.expr(f"array_min(transform(array_distinct({labels}), v -> struct(-size(filter({labels}, u -> u = v)) AS n, v AS v))).v")
