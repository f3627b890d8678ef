"""Hard negatives by rotated one-bit codes with deterministic intervals.

Every vector o is rotated (sign flips and Hadamard transforms) and keeps one bit per coordinate, its sign. With s the unit vector of these signs, o = l s + r, and l, the alignment of
the vector with its code, is stored; r is coded in the same way, ``LEVELS`` codes in all, and the last |r| is stored. For an anchor q the inner product is
the sum of l<q,s> over the levels, and <q,r>; each <q,s> is estimated by popcounts of the code against the bit planes of the anchor's coordinates, off by no more
than their rounding, and <q,r> is at most |r| times the part of q across the last s (Cauchy-Schwarz). So each product lies in an interval that holds without exception. Lower ends that are certain to
count give a threshold; only vectors whose interval reaches it are scored in integers, and the exact scores alone decide.

Two searches: the best rows of the anchor's label, then for every such positive the best rows of other labels within a range of its score. Anchors and rows meet
in blocks of bounded size on both sides, dealt by count, so a label with a third of all rows becomes many equal tasks; each block returns k rows for an anchor.

Defined cases: rows with a null label, id or vector, an empty vector, or null or non-finite components take no part; vectors meet only those of the same
length; equal rows count once; rows that share the anchor's id are neither its positives nor its negatives; ties go to the smaller id. Scores are exact
up to 38 digits whatever the components, larger ones count as 38 nines; one beyond a long is given as the nearest long. Anchors without a row of their label, and positives without a row in range, give no row.
An empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut
from .neardup import usable

ROWS, ASKED, PLANES, TURNS, LEVELS = 4_096, 512, 8, 3, 8
EXACT = 2.0**52  # integer sums below this are exact in double
NINES = 10**38 - 1


def rotate(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Rows of ``x``, padded to a power of two of at least 64 coordinates, under one fixed rotation."""
    n, width = len(x), max(64, 1 << (x.shape[1] - 1).bit_length())
    y = np.zeros((n, width))
    y[:, :x.shape[1]] = x
    draw = np.random.default_rng(seed)
    for _ in range(TURNS):
        y *= draw.integers(0, 2, width) * 2.0 - 1
        h = 1
        while h < width:
            pair = y.reshape(n, -1, 2, h)
            y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
            h *= 2
        y /= np.sqrt(width)
    return y


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits [rows, levels, words], alignment [rows, levels] and norm of the last residual of each row."""
    y = rotate(x)
    bits, along = [], []
    for _ in range(LEVELS):
        sign = y > 0
        length = np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])
        bits.append(np.packbits(sign, axis=1).view(np.uint64))
        along.append(length)
        y = y - length[:, None] * np.where(sign, 1.0, -1.0) / np.sqrt(y.shape[1])
    return np.stack(bits, axis=1), np.stack(along, axis=1), np.sqrt((y * y).sum(axis=1))


def intervals(q: np.ndarray, bits: np.ndarray, along: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends [anchors, rows] of the inner products."""
    y = rotate(q)
    width = y.shape[1]
    low = y.min(axis=1)
    step = np.maximum(y.max(axis=1) - low, 1e-300) / ((1 << PLANES) - 1)
    grid = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint16)
    planes = [np.packbits((grid >> j & 1).astype(np.uint8), axis=1).view(np.uint64) for j in range(PLANES)]
    total = low * width + step * grid.sum(axis=1, dtype=np.int64)
    off = np.abs(y - low[:, None] - step[:, None] * grid).sum(axis=1)[:, None] / np.sqrt(width)
    norm = np.sqrt((y * y).sum(axis=1))[:, None]
    sure = 0.0
    for level in range(LEVELS):
        inside = np.zeros((len(q), len(bits)))
        for j, plane in enumerate(planes):
            for w in range(bits.shape[2]):
                inside += np.bitwise_count(plane[:, w, None] & bits[:, level, w]) * float(1 << j)
        ones = np.bitwise_count(bits[:, level]).sum(axis=1, dtype=np.int64)
        product = (2 * (low[:, None] * ones + step[:, None] * inside) - total[:, None]) / np.sqrt(width)
        sure = sure + along[:, level] * product
    # what the codes leave is at right angles to the last level's signs
    across = np.sqrt(np.maximum(norm**2 - np.maximum(np.abs(product) - off, 0) ** 2, 0))
    half = apart * across + along.sum(axis=1) * off + 1e-9 * norm * (along.sum(axis=1) + apart)
    low, high = sure - half, sure + half
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


def scored(x: np.ndarray, q: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products of one anchor with some rows: in double where sums stay exact, else in Python's integers."""
    if exact:
        return x[rows] @ q
    ints = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(r, ints)) for r in x[rows].tolist()], object)


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by id."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -score))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[-k] if len(values) >= k else -np.inf


def _matrix(column, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _text(scores) -> list[str]:
    return [str(max(min(int(s), NINES), -NINES)) for s in scores]


def _block(search, schema: list[str]):
    """A block's task: anchors against rows, a few at a time; ``search`` yields rows of the result for one anchor."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, asks = pdf[~pdf["ask"]].sort_values(["vec_id", "tag"]), pdf[pdf["ask"]]
        out = []
        if len(rows) and len(asks):
            x, bits, along = _matrix(rows["x"]), _matrix(rows["code"], np.uint64).reshape(len(rows), LEVELS, -1), _matrix(rows["along"])
            apart, ids, labels = (rows[c].to_numpy() for c in ("apart", "vec_id", "label"))
            q = _matrix(asks["x"])
            longest = np.sqrt(max((x * x).sum(axis=1)))
            for i in range(0, len(q), 64):
                low, high = intervals(q[i:i + 64], bits, along, apart)
                for j, ask in enumerate(asks.iloc[i:i + 64].itertuples(index=False)):
                    exact = longest * np.sqrt((q[i + j] ** 2).sum()) < EXACT
                    out += search(ask, q[i + j], x, ids, labels, low[j], high[j], lambda r, e=exact, v=q[i + j]: scored(x, v, r, e))
        return pd.DataFrame(out, columns=schema)
    return run


def _positives(k: int):
    def search(ask, q, x, ids, labels, low, high, score):
        may = (labels == ask.label) & (ids != ask.vec_id)
        rows = np.flatnonzero(may & (high >= _kth(low[may], k)))
        s = score(rows)
        best = first(s, ids[rows], k)
        return [(ask.vec_id, ask.tag, ask.label, i, t) for i, t in zip(ids[rows][best].tolist(), _text(s[best]))]
    return search


def _negatives(k: int, least: int, most: int):
    """Best rows with ``least`` <= 100 * score / positive's score <= ``most``, in integers throughout."""
    def search(ask, q, x, ids, labels, low, high, score):
        other = (labels != ask.label) & (ids != ask.vec_id)
        ranges = {p: (-(-least * p // 100), most * p // 100) for p in {int(p) for p in ask.scores}}
        reach = np.zeros(len(ids), bool)
        for a, b in ranges.values():
            if a <= b:
                sure = other & (low >= a) & (high <= b)
                reach |= other & (low <= b) & (high >= max(_kth(low[sure], k), a))
        rows = np.flatnonzero(reach)
        s = score(rows)
        out = []
        for p, (a, b) in ranges.items():
            inside = np.flatnonzero(((s >= a) & (s <= b)).astype(bool))
            best = inside[first(s[inside], ids[rows][inside], k)]
            out += [(ask.vec_id, ask.tag, str(p), i, t) for i, t in zip(ids[rows][best].tolist(), _text(s[best]))]
        return out
    return search


WIDE = "decimal(38,0)"


def _meet(index: DataFrame, asks: DataFrame, key: list[str], search, schema: str) -> DataFrame:
    """Results of every block of rows with every block of anchors under equal ``key``."""
    asked = asks.groupBy(*key).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("nq"))
    sizes = cut(index.groupBy(*key).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("nr")).join(asked, key), "sizes")
    at = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "tag"), F.col(n)).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["dim", "label", "vec_id", "tag", "x"]
    no_scores = F.lit(None).cast("array<string>")
    rows = index.join(sizes, key).select(*own, "code", "along", "apart", no_scores.alias("scores"), F.lit(False).alias("ask"), at("nr", 1).alias("r"), count("nq").alias("q"))
    nil = F.lit(None)
    more = F.col("scores") if "scores" in asks.columns else no_scores
    asks = asks.join(sizes, key).select(*own, nil.cast("binary").alias("code"), nil.cast("binary").alias("along"), nil.cast("double").alias("apart"), more.alias("scores"),
                                        F.lit(True).alias("ask"), count("nr").alias("r"), at("nq", 2).alias("q"))
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.unionByName(asks).groupBy(*key, "r", "q").applyInPandas(_block(search, names), schema)


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.col("score").cast(WIDE).desc(), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "x") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; components are integers (given as double).

    ``least`` and ``most`` are the percentages of a positive's score between which a negative's score must lie.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("ask"))
    rows = rows.filter(usable(F.col("x")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).distinct()
    rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), "x", "ask", F.xxhash64("label", "x").alias("tag"), F.size("x").alias("dim"))

    def coded(batches):
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                for i in range(0, len(g), 2048):
                    part = g.iloc[i:i + 2048]
                    x = np.array(part["x"].tolist(), np.float64)
                    bits, along, apart = codes(x)
                    yield part.assign(x=[a.tobytes() for a in x], code=[a.tobytes() for a in bits], along=[a.tobytes() for a in along], apart=apart)

    index = cut(rows.mapInPandas(coded, "vec_id long, label string, x binary, ask boolean, tag long, dim int, code binary, along binary, apart double"), "codes")
    asks = index.filter("ask").select("dim", "label", "vec_id", "tag", "x")
    near = _meet(index, asks, ["dim", "label"], _positives(positives), "vec_id long, tag long, label string, other long, score string")
    near = cut(_best(near, ["vec_id", "tag", "label"], positives).select("vec_id", "tag", F.col("other").alias("positive_id"), F.col("score").alias("positive")), "positives")
    scores = near.groupBy("vec_id", "tag").agg(F.collect_set("positive").alias("scores"))  # at most ``positives`` numbers
    far = _meet(index, asks.join(scores, ["vec_id", "tag"]), ["dim"], _negatives(negatives, least, most), "vec_id long, tag long, positive string, other long, score string")
    best = _best(far, ["vec_id", "tag", "positive"], negatives)
    limit = (1 << 63) - 1
    long = lambda c: F.greatest(F.least(F.col(c).cast(WIDE), F.lit(limit).cast(WIDE)), F.lit(-limit - 1).cast(WIDE)).cast("long")
    return near.join(best, ["vec_id", "tag", "positive"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"),
                                                                 long("positive").alias("positive_score"), long("score").alias("negative_score"))
