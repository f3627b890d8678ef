"""Decision trees grown from sums over binned columns, many trees side by side.

A row is its bins, two bytes per column. In each pass every task brings the rows it reads down all trees in progress and adds up gradient, curvature and count per (node,
column, bin); Spark sums these cells and the driver picks the splits. So what travels depends on nodes, columns and bins, not on rows, a pass serves every tree of every model, fold
and class at once, and a lost executor costs its tasks of one pass. Nodes are worked on in waves of at most ``CELLS`` cells.

A split's gain is that of second-order boosting with l1 and l2 penalties and a price per split. With a limit on leaves the best gain is split first; which nodes
that takes is found by replaying the splits known so far, so only nodes that the replay reaches are opened.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut as stored

BINS = 256
SMALL = 1 << 21  # bins up to which a table is sent to tasks that fit whole models
HELD = 384 << 20  # bytes that a boosted model over rows held whole may take for them
CELLS = 1 << 21  # sums of one pass that the driver receives
CHUNK = 1 << 16  # rows held whole that are worked on at once, so that what is made of them stays near the processor
PACKED = 32  # rows that travel together to a task that holds them all
STEPS = 12  # levels of a tree up to which all rows go down together


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 at leaves, and rows with x <= threshold (bin <= cut) go left."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def depth(self) -> int:
        depth, level = 0, np.zeros(1, np.int64)
        while len(level := level[self.feature[level] >= 0]):
            level = np.concatenate([self.left[level], self.right[level]])
            depth += 1
        return depth

    def _down(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        depth = self.depth()
        if depth <= STEPS:
            here, inner = np.arange(len(self.feature)), self.feature >= 0
            feature, left, right = np.where(inner, self.feature, 0), np.where(inner, self.left, here), np.where(inner, self.right, here)
            out = np.zeros(len(x), np.int64)
            for a in range(0, len(x) if depth else 0, CHUNK):
                part = x[a:a + CHUNK]
                first, values, node = np.arange(len(part)) * x.shape[1], part.ravel(), out[a:a + CHUNK]
                for _ in range(depth):
                    node = np.where(values.take(first + feature.take(node)) <= at.take(node), left.take(node), right.take(node))
                out[a:a + CHUNK] = node
            return out
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.feature[node[rows]] >= 0]
            n = node[rows]
            node[rows] = np.where(x[rows, self.feature[n]] <= at[n], self.left[n], self.right[n])
        return node

    def leaves_of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self._down(bins, self.cut)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        return self._down(x, self.threshold)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves_of(x)]


@dataclass
class Growth:
    """How one tree grows. ``columns`` are shares of the columns drawn for the tree, for a level and for a node."""

    max_depth: int = 6
    leaves: int | None = None
    min_rows: int = 1
    min_split: int = 2
    min_weight: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    price: float = 0.0
    columns: tuple[float, float, float] = (1.0, 1.0, 1.0)
    seed: tuple = (1,)


@dataclass
class _Growing:
    spec: Growth
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    depth: list = field(default_factory=lambda: [0])
    sums: dict = field(default_factory=dict)   # node -> (g, h, n)
    best: dict = field(default_factory=dict)   # node -> (gain, column, bin), gain <= 0 where it stays a leaf

    def replay(self) -> tuple[list[int], list[int]]:
        """Nodes that are split, the best gain first, and of these the ones whose children are not made yet."""
        heap, split, new, leaves = [], [], [], 1
        if self.best.get(0, (0,))[0] > 0:
            heap.append((-self.best[0][0], 0))
        while heap and (self.spec.leaves is None or leaves < self.spec.leaves):
            _, node = heapq.heappop(heap)
            split.append(node)
            leaves += 1
            if self.left[node] < 0:
                new.append(node)
                continue
            for child in (self.left[node], self.right[node]):
                if self.best[child][0] > 0:
                    heapq.heappush(heap, (-self.best[child][0], child))
        return split, new

    def open(self, node: int) -> list[int]:
        _, self.feature[node], self.cut[node] = self.best[node]
        made = [len(self.feature), len(self.feature) + 1]
        self.left[node], self.right[node] = made
        for own, new in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.depth, self.depth[node] + 1)):
            own += [new, new]
        return made

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v, np.int64) for v in (self.feature, self.cut, self.left, self.right))

    def _kept(self) -> tuple[set[int], list[int]]:
        """Nodes that are split in the end, and all that are left in their order."""
        split = set(self.replay()[0]) if self.spec.leaves is not None else {n for n, child in enumerate(self.left) if child >= 0}
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            if node in split:
                stack += [self.right[node], self.left[node]]
        return split, order

    def places(self) -> np.ndarray:
        """Where each node, or else the one that is left above it, stands in the tree."""
        _, order = self._kept()
        out = np.full(len(self.feature), -1, np.int32)
        out[order] = np.arange(len(order))
        for node, child in enumerate(self.left):  # children have higher numbers
            if child >= 0:
                for c in (child, self.right[node]):
                    out[c] = out[node] if out[c] < 0 else out[c]
        return out

    def tree(self, edges: list[np.ndarray]) -> Tree:
        split, order = self._kept()
        at = {node: i for i, node in enumerate(order)}
        inner = [n in split for n in order]
        feature = np.array([self.feature[n] if i else -1 for n, i in zip(order, inner)])
        cut = np.array([self.cut[n] if i else 0 for n, i in zip(order, inner)])
        threshold = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(feature, cut)])
        left, right = (np.array([at[side[n]] if i else -1 for n, i in zip(order, inner)]) for side in (self.left, self.right))
        g, h, n = np.array([self.sums[n] for n in order], dtype=float).reshape(-1, 3).T
        return Tree(feature, cut, threshold, left, right, leaf_values(g, h, self.spec), n)


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g: float, h: float, spec: Growth) -> float:
    return float(-shrunk(g, spec.l1) / (h + spec.l2)) if h + spec.l2 > 0 else 0.0


def leaf_values(g: np.ndarray, h: np.ndarray, spec: Growth) -> np.ndarray:
    some = h + spec.l2 > 0
    return np.where(some, -shrunk(g, spec.l1) / np.where(some, h + spec.l2, 1.0), 0.0)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, spec: Growth, allowed: np.ndarray) -> tuple[float, int, int]:
    """Gain, column and last bin of the left side, from sums [columns, bins]; equal gains go to the first column and bin."""
    def worth(g, h):
        return shrunk(g, spec.l1) ** 2 / np.where(h + spec.l2 > 0, h + spec.l2, np.inf)

    gl, hl, nl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1], n.cumsum(axis=1)[:, :-1]
    gt, ht, nt = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
    gain = (worth(gl, hl) + worth(gt - gl, ht - hl) - worth(gt, ht)) / 2 - spec.price
    good = (np.minimum(nl, nt - nl) >= max(spec.min_rows, 1)) & (np.minimum(hl, ht - hl) >= spec.min_weight) & allowed[:, None] & (nt >= spec.min_split)
    gain = np.where(good, gain, -np.inf)
    top = gain.max(initial=-np.inf)
    # sums come in any order: what differs in the last digits is a tie, and a gain within them is none
    floor = 1e-10 * float(np.abs(worth(gt, ht)).max(initial=0.0))
    if not top > floor:
        return 0.0, -1, 0
    column, last = divmod(int(np.argmax(gain >= top - 1e-9 * abs(top))), gain.shape[1])
    return float(top), column, last


def draw_columns(spec: Growth, d: int, depth: int, node: int) -> np.ndarray:
    allowed = np.ones(d, bool)
    for kind, (share, own) in enumerate(zip(spec.columns, ((), (depth,), (depth, node)))):
        open_ = np.flatnonzero(allowed)
        keep = max(1, int(np.ceil(share * len(open_))))
        if keep < len(open_):  # else the draw takes them all
            draw = np.random.default_rng([*spec.seed, kind, *own]).permutation(open_)
            allowed[:] = False
            allowed[draw[:keep]] = True
    return allowed


def _drawn(spec: Growth, d: int, depths: list[int], nodes: list[int]) -> np.ndarray:
    """Columns that each of the nodes may use; nodes of a level share a draw as long as none is made by node."""
    if spec.columns[2] < 1:
        return np.array([draw_columns(spec, d, depth, node) for depth, node in zip(depths, nodes)])
    made = {depth: draw_columns(spec, d, depth, 0) for depth in set(depths)}
    return np.array([made[depth] for depth in depths])


def bin_edges(rows: DataFrame, d: int, bins: int = BINS) -> list[np.ndarray]:
    """Rising upper edges of each column's bins, at quantiles of all rows; a column of few values gets an edge at each of them."""
    share = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.col("x")[j], share, 100 * bins).alias(f"q{j}") for j in range(d)]).first()
    return [np.unique(np.array(q or [], dtype=float)) for q in got]


def binned(rows: DataFrame, edges: list[np.ndarray], label: str = "f") -> DataFrame:
    """key, label, fold, x as bins (two bytes each); ``rows`` has key, label, fold and x."""
    d = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            bins = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), b.column("fold"), pa.array([r.tobytes() for r in bins], pa.binary())], names=["key", "label", "fold", "bins"])

    src = rows.select(F.col("key").cast("long"), F.col("label").cast("double"), F.col("fold").cast("int"), F.col("x").cast("array<double>"))
    return stored(src.mapInArrow(run, "key long, label double, fold int, bins binary"), "bins")


@dataclass
class Batch:
    """Rows of a task: state is whatever doubles the learner keeps per row."""

    key: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    bins: np.ndarray
    state: np.ndarray | None


def batch_of(b: pa.RecordBatch, d: int) -> Batch:
    def flat(name: str, kind, width: int) -> np.ndarray:
        if not len(b):
            return np.zeros((0, width), kind)
        col = b.column(name)
        _, offsets, data = col.buffers()  # the values follow each other
        size = np.dtype(kind).itemsize * width
        return np.frombuffer(data, np.uint8, len(b) * size, int(np.frombuffer(offsets, np.int32, 1, 4 * col.offset)[0])).view(kind).reshape(-1, width)

    state = None
    if "state" in b.schema.names:
        raw = b"".join(b.column("state").to_pylist())
        state = np.frombuffer(raw, np.float64).reshape(len(b), -1)
    key, y, fold = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "label", "fold"))
    return Batch(key, y, fold, flat("bins", np.uint16, d), state)


def unit(key: np.ndarray, *seed: int) -> np.ndarray:
    """A number in [0, 1) that follows from a row's key and the seed, wherever the row lies."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)
        for s in (*seed, 0):
            x = (x + np.uint64(s & (1 << 64) - 1)) * np.uint64(0xD1342543DE82EF95)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def whole(table: DataFrame, d: int) -> Batch:
    """All rows of a small binned table, in the order of their keys."""
    got = table.orderBy("key", "label", "bins").toArrow().combine_chunks()
    return batch_of(got.to_batches()[0], d) if got.num_rows else Batch(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros((0, d), np.uint16), None)


def plain(record) -> tuple:
    """Fields of a dataclass, as they travel between driver and tasks, where the class itself may not be installed."""
    return tuple(vars(record).values())


def in_tasks(spark, n: int, fit: Callable[[int], object]) -> list:
    """``fit(0)`` to ``fit(n - 1)``, plain values each, in a task of its own."""
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "made": [pickle.dumps(fit(int(i))) for i in f["id"]]})

    made = spark.range(n, numPartitions=n).mapInPandas(run, "id long, made binary").collect()
    return [pickle.loads(r["made"]) for r in sorted(made, key=lambda r: r["id"])]


def in_tasks_whole(table: DataFrame, d: int, folds: list[int | None], fit: Callable[[int, Batch], object]) -> list:
    """``fit(i, rows)``, plain values each, in a task of its own that holds all rows of the binned table but those of fold ``folds[i]``, in the order of their keys.

    The rows go from task to task, some packed together; the driver gets what ``fit`` gives.
    """
    kind = np.dtype([("key", "<i8"), ("y", "<f8"), ("fold", "<i4"), ("bins", "<u2", (d,))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                b, own = batch_of(batch, d), np.empty(len(batch), kind)
                own["key"], own["y"], own["fold"], own["bins"] = b.key, b.y, b.fold, b.bins
                yield pa.RecordBatch.from_arrays([pa.array([own[a:a + PACKED].tobytes() for a in range(0, len(own), PACKED)], pa.binary())], names=["rows"])

    sent = table.mapInArrow(pack, "rows binary").withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(len(folds) - 1)))).repartitionById(len(folds), F.col("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, i = [], None
        for b in batches:
            if len(b):
                i = b.column("id")[0].as_py()
                own = np.frombuffer(b"".join(b.column("rows").to_pylist()), kind)
                parts.append(own if folds[i] is None else own[own["fold"] != folds[i]])
        if i is None:
            return
        own = np.concatenate(parts)
        parts.clear()
        own = own[np.lexsort((*own["bins"].T[::-1], own["y"], own["key"]))]
        rows = Batch(*(np.ascontiguousarray(own[c]) for c in ("key", "y", "fold", "bins")), None)
        del own
        yield pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "made": pa.array([pickle.dumps(fit(i, rows))], pa.binary())})

    made = {r["id"]: pickle.loads(r["made"]) for r in sent.mapInArrow(run, "id long, made binary").collect()}
    return [made[i] for i in range(len(folds))]


# per batch: gradient, curvature and membership of every tree in progress, [rows, trees]
RowSums = Callable[[Batch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sums_of(table: DataFrame | Batch, d: int, add: Callable[[Batch, dict], None], shape: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Arrays of the given shapes that ``add`` adds to, batch by batch, summed over all tasks; only cells other than zero travel."""
    if isinstance(table, Batch):  # a small table, held whole by a task that fits one model
        own = {k: np.zeros(s) for k, s in shape.items()}
        add(table, own)
        return own
    names = list(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: np.zeros(s) for k, s in shape.items()}
        for b in batches:
            if len(b):
                add(batch_of(b, d), own)
        flat = {k: v.ravel() for k, v in own.items()}
        for i, k in enumerate(names):
            at = np.flatnonzero(flat[k])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(flat[k][at])], names=["what", "cell", "v"])

    got = table.mapInArrow(run, "what int, cell long, v double").groupBy("what", "cell").agg(F.sum("v").alias("v")).toArrow()
    what, cell, v = (got[c].to_numpy() for c in ("what", "cell", "v"))
    out = {k: np.zeros(int(np.prod(s))) for k, s in shape.items()}
    for i, k in enumerate(names):
        mine = what == i
        out[k][cell[mine]] = v[mine]
    return {k: out[k].reshape(shape[k]) for k in names}


def _down(arrays: tuple[np.ndarray, ...], bins: np.ndarray, depth: int) -> np.ndarray:
    feature, cut, left, right = arrays
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        go = np.where(bins[rows, np.maximum(f, 0)] <= cut[node], left[node], right[node])
        node = np.where(f >= 0, go, node)
    return node


def _cells(place: np.ndarray, bins: np.ndarray, nodes: int, width: int, g: np.ndarray, h: np.ndarray | None):
    """Sums of one column as matrices [nodes, bins]: (nodes, bins or None, g, h, n) each. Where most bins of a node are empty only its filled ones stand in the
    matrix, in their order, together with nodes of about as many."""
    size = nodes * width
    if size <= max(4 * len(place), 1 << 16):
        made = [None if w is None else np.zeros(size) for w in (g, h, g)]
        for a in range(0, len(place), step := max(CHUNK, 2 * size)):
            at = place[a:a + step] * np.int64(width) + bins[a:a + step]
            for own, w in zip(made, (g, h, None)):
                if own is not None:
                    own += np.bincount(at, None if w is None else w[a:a + step], minlength=size)
        yield np.arange(nodes), None, *(None if own is None else own.reshape(nodes, width) for own in made)
        return
    at = place * np.int64(width) + bins
    cell, inverse = np.unique(at, return_inverse=True)
    sums = [None if w is None else np.bincount(inverse, w, minlength=len(cell)) for w in (g, h, np.ones(len(at)))]
    node = cell // width
    count = np.bincount(node, minlength=nodes)
    rank = np.arange(len(cell)) - (count.cumsum() - count)[node]
    size = np.frexp(np.maximum(count - 1, 0))[1]  # up to 2 ** size filled bins
    for z in np.unique(size[count > 0]):
        own = np.flatnonzero((size == z) & (count > 0))
        spot = np.full(nodes, -1)
        spot[own] = np.arange(len(own))
        mine = np.flatnonzero(spot[node] >= 0)
        where = spot[node[mine]], rank[mine]
        made = []
        for v in (cell % width, *sums):
            made.append(None if v is None else np.zeros((len(own), 1 << int(z)), v.dtype))
            if v is not None:
                made[-1][where] = v[mine]
        yield own, *made


def _gains(g: np.ndarray, h: np.ndarray | None, n: np.ndarray, spec: Growth) -> tuple[np.ndarray, np.ndarray]:
    """Gain of a split behind each bin [nodes, bins], and what the nodes are worth unsplit."""
    def worth(g, h):
        return shrunk(g, spec.l1) ** 2 / np.where(h + spec.l2 > 0, h + spec.l2, np.inf)

    gl, nl = g.cumsum(axis=1), n.cumsum(axis=1)
    hl = nl if h is None else h.cumsum(axis=1)
    gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
    alone = worth(gt, ht)
    gain = (worth(gl, hl) + worth(gt - gl, ht - hl) - alone) / 2 - spec.price
    good = (np.minimum(nl, nt - nl) >= max(spec.min_rows, 1)) & (np.minimum(hl, ht - hl) >= spec.min_weight) & (nt >= spec.min_split)
    return np.where(good, gain, -np.inf), alone[:, 0]


def _best_splits(bins: np.ndarray, place: np.ndarray, nodes: int, width: int, g: np.ndarray, h: np.ndarray | None, spec: Growth, allowed: np.ndarray):
    """``best_split`` of many nodes at once: gains, columns and bins. ``bins`` is [columns, rows]."""
    if nodes > 1 and nodes * width > CELLS:  # some nodes after others, each with its rows
        order = np.argsort(place.astype(np.uint16) if nodes < 1 << 16 else place, kind="stable")
        ends = np.bincount(place, minlength=nodes).cumsum()
        some, out = max(CELLS // width, 1), []
        for first in range(0, nodes, some):
            last = min(first + some, nodes)
            own = order[ends[first - 1] if first else 0:ends[last - 1]]
            out.append(_best_splits(bins[:, own], place[own] - first, last - first, width, g[own], None if h is None else h[own], spec, allowed[first:last]))
        return tuple(np.concatenate(v) for v in zip(*out))
    top, floor = np.full(nodes, -np.inf), np.zeros(nodes)
    found = []
    for j in np.flatnonzero(allowed.any(axis=0)):
        for own, at, *sums in _cells(place, bins[j], nodes, width, g, h):
            gain, alone = _gains(*sums, spec)
            gain[~allowed[own, j]] = -np.inf
            found.append((j, own, at, gain))
            top[own] = np.maximum(top[own], gain.max(axis=1))
            floor[own] = np.maximum(floor[own], 1e-10 * np.abs(alone))
    split = top > floor
    column, last = np.full(nodes, -1), np.zeros(nodes, np.int64)
    least = top - 1e-9 * np.abs(top)
    for j, own, at, gain in found:
        hit = gain >= least[own, None]
        first = hit.argmax(axis=1)
        new = split[own] & (column[own] < 0) & hit.any(axis=1)
        rows = np.flatnonzero(new)
        column[own[new]] = j
        last[own[new]] = first[new] if at is None else at[rows, first[new]]
    return np.where(split, top, 0.0), column, last


def _grow_whole(bins: np.ndarray, g: np.ndarray, h: np.ndarray | None, edges: list[np.ndarray], spec: Growth, leaves: list | None = None) -> Tree:
    """One tree over rows that a task holds whole; a row's node is kept, and all nodes of a step are searched together. ``bins`` is [columns, rows], curvatures of 1 are None.
    The rows' leaves are added to ``leaves``."""
    d, width = len(edges), max([len(e) + 1 for e in edges], default=1)
    tree = _Growing(spec)
    ranked = spec.leaves is not None or spec.columns[2] < 1  # what the nodes are numbered by matters
    node_of, waiting, flat = np.zeros(len(g), np.int32), [0], bins.ravel()
    while waiting:
        slot = np.full(len(tree.feature), -1, np.int32)
        slot[waiting] = np.arange(len(waiting))
        place = slot[node_of]
        rows = np.flatnonzero(place >= 0)
        if len(rows) == len(g):
            bw, gw, hw = bins, g, h
        else:
            place, bw, gw, hw = place[rows], bins[:, rows], g[rows], None if h is None else h[rows]
        n = np.bincount(place, minlength=len(waiting))
        gs, hs = np.bincount(place, gw, minlength=len(waiting)), n if h is None else np.bincount(place, hw, minlength=len(waiting))
        depths = [tree.depth[node] for node in waiting]
        allowed = _drawn(spec, d, depths, waiting) & (np.array(depths) < spec.max_depth)[:, None]
        best = _best_splits(bw, place, len(waiting), width, gw, hw, spec, allowed)
        for node, *own in zip(waiting, gs.tolist(), hs.tolist(), n.tolist(), *(b.tolist() for b in best)):
            tree.sums[node], tree.best[node] = tuple(own[:3]), tuple(own[3:])
        new = tree.replay()[1] if ranked else [node for node in waiting if tree.best[node][0] > 0]
        waiting = [child for node in new for child in tree.open(node)]
        if new:
            # the right child stands behind the left one; nodes that are not opened now lead to themselves
            first, cut, left = np.zeros(len(tree.feature), np.int64), np.full(len(tree.feature), np.iinfo(bins.dtype).max, bins.dtype), np.arange(len(tree.feature))
            for node in new:
                first[node], cut[node], left[node] = tree.feature[node] * len(g), tree.cut[node], tree.left[node]
            for a in range(0, len(g), CHUNK):
                node = node_of[a:a + CHUNK].astype(np.int64)
                at = first.take(node, mode="clip") + np.arange(a, a + len(node))
                node_of[a:a + CHUNK] = left.take(node, mode="clip") + (flat.take(at, mode="clip") > cut.take(node, mode="clip"))
    if leaves is not None:
        leaves.append(tree.places()[node_of])
    return tree.tree(edges)


def grow(table: DataFrame | Batch, edges: list[np.ndarray], rows: RowSums, specs: list[Growth], leaves: list | None = None) -> list[Tree]:
    """One tree per spec, all in the same passes. Of rows held whole their leaves in each tree are added to ``leaves``."""
    if isinstance(table, Batch):
        g, h, m = rows(table)
        bins, out = np.ascontiguousarray(table.bins.T), []
        for t, spec in enumerate(specs):
            own = slice(None) if m[:, t].all() else m[:, t]
            gt, ht, found = np.ascontiguousarray(g[own, t]), h[own, t], [] if leaves is not None and isinstance(own, slice) else None
            out.append(_grow_whole(bins if isinstance(own, slice) else bins[:, own], gt, None if bool((ht == 1).all()) else np.ascontiguousarray(ht), edges, spec, found))
            if leaves is not None:
                leaves.append(out[-1].leaves_of_bins(table.bins) if found is None else found[0])
        return out
    d, width = len(edges), max([len(e) + 1 for e in edges], default=1)
    trees = [_Growing(s) for s in specs]
    waiting = [(t, 0) for t in range(len(specs))]
    while waiting:
        for a in range(0, len(waiting), max(1, CELLS // (3 * d * width))):
            wave = waiting[a:a + max(1, CELLS // (3 * d * width))]
            first: dict[int, int] = {}  # a tree's nodes stand together in a wave
            slots: dict[int, np.ndarray] = {}
            for s, (t, node) in enumerate(wave):
                slots.setdefault(t, np.full(len(trees[t].feature), -1))[node] = s - first.setdefault(t, s)
            plan = {t: (trees[t].arrays(), max(trees[t].depth), slot, first[t] * d * width, (slot.max() + 1) * d * width) for t, slot in slots.items()}

            def add(b: Batch, own: dict) -> None:
                g, h, m = rows(b)
                for t, (arrays, depth, slot, begin, size) in plan.items():
                    place = slot[_down(arrays, b.bins, depth)]
                    mine = np.flatnonzero((place >= 0) & m[:, t])
                    at = ((place[mine, None] * d + np.arange(d)) * width + b.bins[mine]).ravel()
                    for name, w in (("g", g[mine, t]), ("h", h[mine, t]), ("n", np.ones(len(mine)))):
                        own[name][begin:begin + size] += np.bincount(at, np.repeat(w, d), minlength=size)

            n_cells = len(wave) * d * width
            got = sums_of(table, d, add, {k: (n_cells,) for k in "ghn"})
            g, h, n = (got[k].reshape(len(wave), d, width) for k in "ghn")
            for s, (t, node) in enumerate(wave):
                tree = trees[t]
                tree.sums[node] = g[s, 0].sum(), h[s, 0].sum(), n[s, 0].sum()
                deep = tree.depth[node] >= tree.spec.max_depth
                tree.best[node] = (0.0, -1, 0) if deep else best_split(g[s], h[s], n[s], tree.spec, draw_columns(tree.spec, d, tree.depth[node], node))
        waiting = [(t, child) for t, tree in enumerate(trees) for node in tree.replay()[1] for child in tree.open(node)]
    return [t.tree(edges) for t in trees]


def _ordered(v: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    raw = np.ascontiguousarray(v + 0.0).view(np.int64)
    return np.where(raw >= 0, raw, np.int64(-(1 << 63)) - raw).astype(np.int64)


def _doubles(k: np.ndarray) -> np.ndarray:
    return np.where(k >= 0, k, np.int64(-(1 << 63)) - k).astype(np.int64).view(np.float64)


def group_quantiles(table: DataFrame | Batch, d: int, groups: int, rows: Callable[[Batch], Iterator[tuple[np.ndarray, np.ndarray]]], share: np.ndarray | float) -> np.ndarray:
    """Exact lower quantiles: the least value that at least ``share`` of a group's values do not exceed. ``rows`` yields (group, value) arrays of a batch.

    A bracket per group is cut into parts until it holds one value, so a group may have any number of rows. Groups without values get 0.
    """
    if isinstance(table, Batch):
        group, value = (np.concatenate(v) for v in zip(*rows(table)))
        order = np.lexsort((value, group))
        n, ends = np.bincount(group, minlength=groups), np.bincount(group, minlength=groups).cumsum()
        place = np.maximum(np.ceil(share * n - 1e-9), 1).astype(int) - 1
        return np.array([value[order[e - c + k]] if c else 0.0 for e, c, k in zip(ends, n, place)])
    steps = int(np.clip((1 << 19) // groups, 256, 1 << 16))
    low, high = np.full(groups, -(1 << 62), np.int64) * 2, np.full(groups, (1 << 63) - 1, np.int64)
    rank = None
    below = np.zeros(groups)
    while True:
        left = high.view(np.uint64) - low.view(np.uint64)
        size = (left // np.uint64(steps)) + np.uint64(1)
        open_ = left > 0
        if not open_.any():
            return _doubles(low)

        def add(b: Batch, own: dict) -> None:
            for group, value in rows(b):
                k = _ordered(value)
                some = open_[group] & (k >= low[group]) & (k <= high[group])
                at = (k[some].view(np.uint64) - low[group[some]].view(np.uint64)) // size[group[some]]
                own["n"] += np.bincount(group[some] * steps + at.astype(np.int64), minlength=groups * steps)

        n = sums_of(table, d, add, {"n": (groups * steps,)})["n"].reshape(groups, steps)
        if rank is None:
            total = n.sum(axis=1)
            rank = np.maximum(np.ceil(share * total - 1e-9), 1)
            zero = _ordered(np.zeros(1))[0]
            low, high = np.where(total > 0, low, zero), np.where(total > 0, high, zero)
            open_ &= total > 0
        upto = below[:, None] + n.cumsum(axis=1)
        part = np.argmax(upto >= rank[:, None], axis=1)
        now = np.flatnonzero(open_)
        below[now] = np.where(part[now] > 0, upto[now, np.maximum(part[now] - 1, 0)], below[now])
        start = low.view(np.uint64) + part.astype(np.uint64) * size
        stop = np.minimum(start - low.view(np.uint64) + size - np.uint64(1), left) + low.view(np.uint64)
        low[now], high[now] = start.view(np.int64)[now], stop.view(np.int64)[now]
