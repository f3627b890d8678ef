"""Shared second moments: one scan gives the sums behind every least-squares fit on a table.

A row counts for a column tuple when it is complete in the tuple's columns. Rows without gaps are summed once for
all tuples, rows with gaps per tuple. Since the train/test side of a row does not depend on the tuple, all tuples
share the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SUM_SCHEMA = "grp string, slot int, v double"


@dataclass
class Sums:
    """Sums of one group over some columns, taken about their centres."""

    n: float
    low: np.ndarray
    s: np.ndarray
    ss: np.ndarray


@dataclass
class Moments:
    n: float
    mean: np.ndarray
    scatter: np.ndarray  # sum of centred outer products

    @property
    def cov(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)


def column_means(df: DataFrame, cols: list[str], log: bool = False) -> dict[str, np.ndarray]:
    """Centres for the sums, of the columns and with ``log`` of their logarithms, from one aggregate.

    Any value near the mean will do as a centre; it only keeps digits.
    """
    def one(c, lg):
        v = F.col(c).cast("double")
        return F.avg(F.when(v > 0, F.ln(v))) if lg else F.avg(v)

    kinds = [False, True] if log else [False]
    row = df.agg(*[one(c, lg).alias(f"m{i}_{int(lg)}") for lg in kinds for i, c in enumerate(cols)]).first()
    flat = np.array([v if v is not None else 0.0 for v in row]).reshape(len(kinds), len(cols))
    return dict(zip(("raw", "log"), flat))


def accumulate(df: DataFrame, cols: list[str], shifts: dict[str, np.ndarray], group=None, picks: list[list[int]] = ()) -> dict[str, dict[str, dict[int, Sums]]]:
    """Sums per kind (``raw``, ``log``), value of ``group`` (a Column, as text) and place in ``picks``.

    Rows complete in all columns are summed once, under -1. The others are summed for each tuple of ``picks`` that they are
    complete in, so what a task sends is bounded by the tuples, however the gaps lie. Spark adds the partials by (group,
    slot). Both kinds share the scan.
    """
    d = len(cols)
    every = list(range(d))

    def partials(batches):
        acc: dict[tuple, list] = {}

        def add(key, x, low):
            a = acc.get(key)
            if a is None:
                acc[key] = [float(len(x)), low.min(axis=0), x.sum(axis=0), x.T @ x]
            else:
                a[0] += len(x)
                a[1] = np.minimum(a[1], low.min(axis=0))
                a[2] += x.sum(axis=0)
                a[3] += x.T @ x

        for b in batches:
            if len(b) == 0:
                continue
            low = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
            gone = np.isnan(low)
            whole = ~gone.any(axis=1)
            names, code = np.unique(b.column(d).to_pylist(), return_inverse=True)
            for kind, shift in shifts.items():
                val = (np.log(np.where(low > 0, low, 1.0)) if kind == "log" else low) - shift
                for g, name in enumerate(names):
                    mine = code.ravel() == g
                    full = mine & whole
                    if full.any():
                        add((kind, name, -1), val[full], low[full])
                    part = mine & ~whole
                    if not len(picks) or not part.any():
                        continue
                    v, lo, miss = val[part], low[part], gone[part]
                    for t, pick in enumerate(picks):
                        ok = ~miss[:, pick].any(axis=1)
                        if ok.any():
                            add((kind, name, t), v[ok][:, pick], lo[ok][:, pick])
        for (kind, name, t), (n, lo, s, ss) in acc.items():
            v = np.concatenate([[n], lo, s, ss[np.triu_indices(len(s))]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{kind}|{t}|{name}"] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["grp", "slot", "v"])

    grp = (F.lit("all") if group is None else group.cast("string")).alias("__g")
    parts = df.select(*[F.col(c).cast("double") for c in cols], grp).mapInArrow(partials, SUM_SCHEMA)
    # the slots after the count hold minima, all others sums
    rows = parts.groupBy("grp", "slot").agg(F.sum("v").alias("s"), F.min("v").alias("m")).collect()
    out: dict[str, dict[str, dict[int, Sums]]] = {k: {} for k in shifts}
    flat: dict[str, list] = {}
    for r in rows:
        flat.setdefault(r["grp"], []).append((r["slot"], r["s"], r["m"]))
    for key, slots in flat.items():
        kind, t, name = key.split("|", 2)
        m = len(every if t == "-1" else picks[int(t)])
        slots.sort()
        v, low = np.array([x[1] for x in slots]), np.array([x[2] for x in slots[1:1 + m]])
        ss = np.zeros((m, m))
        ss[np.triu_indices(m)] = v[1 + 2 * m:]
        out[kind].setdefault(name, {})[int(t)] = Sums(v[0], low, v[1 + m:1 + 2 * m], ss + np.triu(ss, 1).T)
    return out


def moments(parts: list[dict[int, Sums]], shift: np.ndarray, pick: list[int], place: int = -1) -> tuple[Moments, np.ndarray]:
    """Moments and minima of the picked columns over the rows complete in them; ``place`` is the tuple's place in ``picks``."""
    ix = np.ix_(pick, pick)
    use = [Sums(p[-1].n, p[-1].low[pick], p[-1].s[pick], p[-1].ss[ix]) for p in parts if -1 in p]
    use += [p[place] for p in parts if place >= 0 and place in p]
    n = sum(p.n for p in use)
    if not n:
        return Moments(0, np.full(len(pick), np.nan), np.zeros((len(pick), len(pick)))), np.full(len(pick), np.inf)
    s = sum(p.s for p in use)
    ss = sum(p.ss for p in use)
    return Moments(n, shift[pick] + s / n, ss - np.outer(s, s) / n), np.min([p.low for p in use], axis=0)


def table_moments(df: DataFrame, cols: list[str]) -> Moments:
    """Mean and scatter of complete rows."""
    shift = column_means(df, cols)
    parts = accumulate(df, cols, shift)["raw"].get("all", {})
    return moments([parts], shift["raw"], list(range(len(cols))))[0]


def least_squares(m: Moments, xi: list[int], yi: list[int]) -> np.ndarray | None:
    """Intercept row and weights, shape (1 + inputs, outputs), from moments; minimum norm if singular."""
    if m.n < 2:
        return None
    w = np.linalg.pinv(m.scatter[np.ix_(xi, xi)], rcond=1e-12, hermitian=True) @ m.scatter[np.ix_(xi, yi)]
    b = m.mean[yi] - m.mean[xi] @ w
    return np.vstack([b, w])


def solve(m: Moments, x: list[int], y: list[int]) -> np.ndarray | None:
    """Scale columns to unit variance before :func:`least_squares`, so units do not decide the rank."""
    sd = np.sqrt(np.diag(m.scatter))
    sd = np.where(sd > 0, sd, 1.0)
    scaled = Moments(m.n, m.mean / sd, m.scatter / np.outer(sd, sd))
    c = least_squares(scaled, x, y)
    if c is None:
        return None
    c = c * sd[y]
    c[1:] /= sd[x][:, None]
    return c
