"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Equal vectors of a label are counted first and compared once. A vector's home is the cell of its nearest centre. Two vectors with a
cosine of at least c are within the chord s = sqrt(2 - 2c), so the partner of x can be at home in a cell only if x is within s of that
cell's side of the bisecting plane: x visits exactly those cells, and no link is lost whatever the centres are. Cells are
cut in blocks on both sides, so that a cell with a third of all rows becomes many equal tasks.

The centres are fitted on a sample of at most ``SAMPLE`` vectors, chosen by hash; their number follows the number of vectors up
to ``CELLS``. Only their quality, never the result, depends on that. In a space of many dimensions with a wide threshold nearly every cell is
within reach, and the work then is that of all pairs of a label; tight data or a higher threshold prune.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without label or id, link with nothing;
vectors of different length do not link; rows with one id are one node; repeated rows link with each other. An empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .graph import components, local_roots

SAMPLE, CELLS, CELL_ROWS, BLOCK = 20_000, 1024, 5_000, 2_048


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def on_grid(vector: Column, times: int) -> Column:
    """floor(times * x) of each component, as double; values without a fraction stay as they are."""
    def one(x: Column) -> Column:
        y = F.lit(times) * x.cast("double")
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(F.when(F.abs(y) < F.lit(2.0**52), y)).cast("double")).otherwise(y)
    return F.transform(vector, one)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centres of unit rows; the first ones are spread by taking rows far from those before."""
    centres = [x[0]]
    near = x @ centres[0]
    for _ in range(1, min(k, len(x))):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def reach(x: np.ndarray, centres: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row, and a mask [rows, cells] of the cells that a partner within ``chord`` may be at home in."""
    cos = x @ centres.T
    home = cos.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[home]
    return home, (cos[np.arange(len(x)), home][:, None] - cos) <= chord * apart + 1e-9


def _unit(rows) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(list(rows), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True), x


def _compare(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, ask = pdf[pdf["base"]], pdf[~pdf["base"]]
        if not len(base) or not len(ask):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype({"rep": "int64", "links": "int64", "root": "int64"})
        b, q = (np.frombuffer(b"".join(d["unit"]), np.float64).reshape(len(d), -1) for d in (base, ask))
        ids, other = base["rep"].to_numpy(), ask["rep"].to_numpy()
        hit = (q @ b.T >= least) & (other[:, None] != ids)
        links = ask["copies"].to_numpy() @ hit
        names, code = np.unique(np.r_[ids, other], return_inverse=True)
        r, c = np.nonzero(hit)
        root = local_roots(len(names), code[len(ids) + r], code[c])
        total = np.bincount(code[:len(ids)], weights=links, minlength=len(names))
        some = (root != np.arange(len(names))) | (total > 0)
        return pd.DataFrame({"rep": names[some], "links": total[some].astype(np.int64), "root": names[root[some]]})
    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cells: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links are pairs of equal label with a cosine of at least ``least``."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2"),
                          v.cast("array<double>").alias("vector"))
    good = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    valid = rows.filter(good)
    one = cut(valid.groupBy("label", "h1", "h2").agg(F.min(F.struct("vec_id", "vector")).alias("first"), F.count("*").alias("copies"))
              .select("label", "h1", "h2", F.col("first.vec_id").alias("rep"), F.col("first.vector").alias("vector"), "copies", F.size("first.vector").alias("dim")), "vectors")
    total = one.count()
    cells = cells or int(np.clip(total // CELL_ROWS, 1, CELLS))
    # a hash threshold near the bound first, so that ordering sees few rows
    order = F.xxhash64(F.lit(3), "rep", "h1")
    share = int(min(1.0, 1.5 * SAMPLE / max(total, 1)) * (1 << 30))
    sample = one.filter(F.pmod(order, F.lit(1 << 30)) < share).orderBy(order).limit(SAMPLE).select("dim", "vector").toPandas()
    centres = {int(d): spherical_kmeans(_unit(g["vector"])[0], cells) for d, g in sample.groupby("dim")}
    chord = float(np.sqrt(max(2 - 2 * least, 0)))

    def assign(batches):
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                for i in range(0, len(g), 4096):
                    part = g.iloc[i:i + 4096]
                    unit, _ = _unit(part["vector"])
                    if dim in centres:
                        home, visits = reach(unit, centres[dim], chord)
                    else:  # a length that the sample lacks: one cell
                        home, visits = np.zeros(len(part), np.int64), np.ones((len(part), 1), bool)
                    yield pd.DataFrame({"label": part["label"], "dim": dim, "rep": part["rep"], "copies": part["copies"], "unit": [u.tobytes() for u in unit], "home": home,
                                        "visits": [np.flatnonzero(m).tolist() for m in visits]})

    kind = dict(one.dtypes)["label"]
    placed = cut(one.select("label", "dim", "rep", "copies", "vector").mapInPandas(assign, f"label {kind}, dim int, rep long, copies long, unit binary, home int, visits array<int>"), "cells")
    key = ["label", "dim", "cell"]
    spread = placed.select("label", "dim", "rep", "copies", "unit", F.explode("visits").alias("cell"), "home")
    sizes = cut(spread.groupBy(*key).agg(F.ceil(F.sum((F.col("home") == F.col("cell")).cast("long")) / BLOCK).cast("int").alias("nb"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nq"))
                .filter("nb > 0"), "sizes")
    got = spread.join(sizes, key)
    at = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = [*key, "rep", "copies", "unit"]
    base = got.filter("home = cell").select(*out, F.lit(True).alias("base"), at("nb", 7).alias("b"), count("nq").alias("q"))
    ask = got.select(*out, F.lit(False).alias("base"), count("nb").alias("b"), at("nq", 8).alias("q"))
    found = cut(base.unionByName(ask).groupBy(*key, "b", "q").applyInPandas(_compare(least), "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found, "rep", "root").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    groups = one.select("label", "h1", "h2", "rep", "copies").join(links, "rep", "left").join(comp, "rep", "left")
    # the hashes of rows without a partner table are nulled, so that they meet nothing
    keyed = rows.select("vec_id", *[F.when(good, F.col(c)).alias(c) for c in ("label", "h1", "h2")])
    got = keyed.join(groups, ["label", "h1", "h2"], "left")
    own = F.coalesce("comp", "rep", "vec_id")
    return got.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
