"""Exact top-k inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; a pivot's vectors are cut in annuli. For a query q and an annulus around
p with distances [a, b] the triangle inequality gives a distance of at least m = max(0, |q-p| - b, a - |q-p|), hence a score of at most
(|q|^2 + N - m^2) / 2 with N the largest squared norm there. A query first goes to its most promising annuli, whose k-th score then
rules out annuli; it visits all that remain, so the result is exact for any pivots.

Queries and annuli meet in blocks of bounded size on both sides. Of equal vectors only the k + 1 smallest ids can be in a result, which is settled
before anything moves. Pivots and annulus limits come from a sample of at most ``SAMPLE`` vectors chosen by hash; every vector is indexed. What
the driver holds is one line per annulus, at most ``PIVOTS * RINGS``.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without id, take no part; vectors meet only those of the
same length; rows with the query's own id are no candidates; ties go to the smaller id. An empty table gives an empty table; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut
from .neardup import usable

SAMPLE, PIVOTS, RINGS, ROWS, ASKED = 20_000, 128, 32, 4_096, 1_024
FOUND = "query_id long, vec_id long, score double"


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k best finite scores, ties by id; ``ids`` are the columns' ids in rising order."""
    k = min(k, scores.shape[1])
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
    o = np.lexsort((c, -scores[r, c], r))
    r, c = r[o], c[o]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _search(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, asks = pdf[~pdf["ask"]].sort_values("vec_id"), pdf[pdf["ask"]]
        out = []
        if len(rows) and len(asks):
            x, ids, q, names = _matrix(rows["x"]), rows["vec_id"].to_numpy(), _matrix(asks["x"]), asks["vec_id"].to_numpy()
            for i in range(0, len(q), 128):
                s = q[i:i + 128] @ x.T
                s[names[i:i + 128, None] == ids] = -np.inf
                r, c = best(s, ids, k)
                out.append(pd.DataFrame({"query_id": names[i:i + 128][r], "vec_id": ids[c], "score": s[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    return run


def _meet(index: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Best scores between the visiting queries (vec_id, x, dim, block) and the vectors of their annuli."""
    key = ["dim", "block"]
    asked = visits.groupBy(*key).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("nq"))
    sizes = cut(index.groupBy(*key).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("nr")).join(asked, key), "sizes")
    at = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(n)).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.join(sizes, key).select(*key, "vec_id", "x", F.lit(False).alias("ask"), at("nr", 1).alias("r"), count("nq").alias("q"))
    asks = visits.join(sizes, key).select(*key, "vec_id", "x", F.lit(True).alias("ask"), count("nr").alias("r"), at("nq", 2).alias("q"))
    found = rows.unionByName(asks).groupBy(*key, "r", "q").applyInPandas(_search(k), FOUND)
    return cut(_ranked(found, k).drop("rank"), "found")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "x", pivots: int | None = None, rings: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (double) of the k rows with the highest inner product for each row where ``is_query``."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x"), F.coalesce(is_query, F.lit(False)).alias("ask"), F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2"))
    rows = rows.filter(usable(F.col("x")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("x"))
    # equal vectors: queries all stay, of the others the smallest k + 1 ids
    near = F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.select("vec_id", "x", "dim", "h1", "h2").withColumn("nth", near).filter(F.col("nth") <= k + 1)
    few = cut(few.drop("nth", "h1", "h2"), "vectors")
    asked = rows.filter("ask").select("vec_id", "x", "dim")
    total = few.count()
    pivots = pivots or int(np.clip(np.sqrt(total) / 8, 1, PIVOTS))
    rings = rings or int(np.clip(total / (pivots * 1024), 1, RINGS))
    order = F.xxhash64(F.lit(3), "vec_id")
    share = int(min(1.0, 1.5 * SAMPLE / max(total, 1)) * (1 << 30))
    sample = few.filter(F.pmod(order, F.lit(1 << 30)) < share).orderBy(order).limit(SAMPLE).toPandas()
    plan: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, g in sample.groupby("dim"):
        x = np.array(g["x"].tolist(), np.float64)
        p = np.unique(x[:pivots], axis=0)
        d = _distances(x, p)
        home = d.argmin(axis=1)
        grid = np.linspace(0, 1, rings + 1)[1:-1]
        plan[int(dim)] = p, np.array([np.quantile(d[home == j, j], grid) if (home == j).any() else np.zeros(len(grid)) for j in range(len(p))]).reshape(len(p), -1)
    first = lambda dim, width: plan.get(dim, (np.zeros((1, width)), np.zeros((1, rings - 1))))  # noqa: E731  a length that the sample lacks

    def keyed(batches):
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                for i in range(0, len(g), 4096):
                    part = g.iloc[i:i + 4096]
                    x = np.array(part["x"].tolist(), np.float64)
                    p, limits = first(int(dim), x.shape[1])
                    d = _distances(x, p)
                    home = d.argmin(axis=1)
                    near = d[np.arange(len(x)), home]
                    ring = (near[:, None] > limits[home]).sum(axis=1)
                    yield pd.DataFrame({"vec_id": part["vec_id"], "x": [a.tobytes() for a in x], "dim": dim, "block": home * rings + ring, "near": near, "norm2": (x * x).sum(axis=1)})

    index = cut(few.mapInPandas(keyed, "vec_id long, x binary, dim int, block int, near double, norm2 double"), "index")
    # one line per annulus
    lines = index.groupBy("dim", "block").agg(F.min("near").alias("a"), F.max("near").alias("b"), F.max("norm2").alias("n"), F.count("*").alias("rows")).toPandas()

    def visits(seen_k: bool):
        """Annuli of each query: without a k-th score the best that hold k + 1 rows, else all others that may reach it."""
        def run(batches):
            for pdf in batches:
                for dim, g in pdf.groupby("dim"):
                    line = lines[lines["dim"] == dim]
                    block, a, b, n, size = (line[c].to_numpy() for c in ("block", "a", "b", "n", "rows"))
                    for i in range(0, len(g), 512):
                        part = g.iloc[i:i + 512]
                        x = np.array(part["x"].tolist(), np.float64)
                        d = _distances(x, first(int(dim), x.shape[1])[0])[:, block // rings]
                        away = np.maximum(0, np.maximum(d - b, a - d))
                        top = ((x * x).sum(axis=1)[:, None] + n - away * away) / 2
                        top += 1e-9 * (np.abs(top) + (x * x).sum(axis=1)[:, None] + n)
                        o = np.argsort(-top, axis=1, kind="stable")
                        held = np.cumsum(size[o], axis=1) - size[o]
                        begun = np.zeros(top.shape, bool)
                        np.put_along_axis(begun, o, held < k + 1, axis=1)
                        go = begun if not seen_k else ~begun & (top >= part["least"].to_numpy()[:, None])
                        r, c = np.nonzero(go)
                        names, raw = part["vec_id"].to_numpy(), [v.tobytes() for v in x]
                        yield pd.DataFrame({"vec_id": names[r], "x": [raw[j] for j in r], "dim": dim, "block": block[c]})
        return run

    schema = "vec_id long, x binary, dim int, block int"
    begun = _meet(index, cut(asked.mapInPandas(visits(False), schema), "visits"), k)
    least = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    known = asked.join(least, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "x", "dim", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    rest = _meet(index, cut(known.mapInPandas(visits(True), schema), "visits"), k)
    return _ranked(begun.unionByName(rest), k)
