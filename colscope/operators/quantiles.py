"""Exact quantiles of many columns without ever gathering the values of a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

BINS = 512
GATHER = 20_000
FEW = 4_000  # columns with fewer distinct values are counted value by value


def _at_ranks(counted: list[tuple[float, int]], ranks: list[int], seen: int) -> dict[int, float]:
    """Values at sorted ranks, walking counted values with ``seen`` rows before them."""
    out, todo = {}, list(ranks)
    for v, k in counted:
        seen += k
        while todo and todo[0] < seen:
            out[todo.pop(0)] = v
    return out


def _order_stats(df: DataFrame, want: dict[str, list[int]], bounds: dict[str, tuple[float, float, int]], distinct: dict[str, int]):
    """Values at the given 0-based ranks of each column.

    Every pass counts the open brackets in ``BINS`` bins and keeps the bin that holds the rank, so a
    bracket shrinks by that factor per scan. Brackets with few rows, or a single value, end as a
    counted list of distinct values.
    """
    found: dict[tuple[str, int], float] = {}
    # (column, lo, hi, rows below lo) -> ranks looked for in it; hi is inclusive
    open_: dict[tuple, list[int]] = {}
    for c, ranks in want.items():
        lo, hi, n = bounds[c]
        open_[(c, lo, hi, 0, n)] = sorted(set(ranks))
    few = [c for c in want if bounds[c][2] > GATHER and distinct[c] < FEW]
    if few:
        counted = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("b"), F.col(c).cast("double").alias("v")) for i, c in enumerate(few)])))
        counted = counted.where(F.abs("v") < F.lit(math.inf))
        per: dict[int, list] = {}
        for r in counted.groupBy("b", "v").count().collect():
            per.setdefault(r["b"], []).append((r["v"], r["count"]))
        for i, c in enumerate(few):
            found.update({(c, r): v for r, v in _at_ranks(sorted(per[i]), sorted(set(want[c])), 0).items()})
            del open_[(c, bounds[c][0], bounds[c][1], 0, bounds[c][2])]
    while open_:
        todo, leaves, open_ = open_, {}, {}
        brackets = []
        for b, ranks in todo.items():
            c, lo, hi, skip, n = b
            if lo == hi:
                found.update({(c, r): lo for r in ranks})
            elif n <= GATHER or math.nextafter(lo, hi) == hi or hi / BINS - lo / BINS == 0.0:
                leaves[b] = ranks
            else:
                brackets.append(b)
        if leaves:
            keys = list(leaves)
            picks = [F.when(F.col(c).between(lo, hi), F.struct(F.lit(i).alias("b"), F.col(c).cast("double").alias("v")))
                     for i, (c, lo, hi, _, _) in enumerate(keys)]
            # at most GATHER distinct values per bracket, counted before they reach the driver
            rows = (df.select(F.explode(F.array_compact(F.array(*picks))).alias("s")).select("s.*")
                    .groupBy("b", "v").count().collect())
            per = {}
            for r in rows:
                per.setdefault(r["b"], []).append((r["v"], r["count"]))
            for i, b in enumerate(keys):
                found.update({(b[0], r): v for r, v in _at_ranks(sorted(per.get(i, [])), leaves[b], b[3]).items()})
        if brackets:
            picks = []
            for i, (c, lo, hi, _, _) in enumerate(brackets):
                v = F.col(c).cast("double")
                # divided before they are subtracted, as hi - lo may be beyond the largest double
                width = hi / BINS - lo / BINS
                pos = F.least(F.greatest(F.floor(v / F.lit(width) - F.lit(lo / width)), F.lit(0)), F.lit(BINS - 1))
                picks.append(F.when(v.between(lo, hi), F.struct(F.lit(i).alias("b"), pos.cast("int").alias("bin"), v.alias("v"))))
            rows = (df.select(F.explode(F.array_compact(F.array(*picks))).alias("s")).select("s.*")
                    .groupBy("b", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                    .collect())
            per = {}
            for r in rows:
                per.setdefault(r["b"], []).append((r["bin"], r["n"], r["lo"], r["hi"]))
            for i, b in enumerate(brackets):
                seen, ranks = b[3], list(todo[b])
                for _, n, lo, hi in sorted(per[i]):
                    mine = [r for r in ranks if seen <= r < seen + n]
                    if mine:
                        open_[(b[0], lo, hi, seen, n)] = mine
                    seen += n
    return found


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, nulls and NaN left out, for each column. Infinities are counted apart."""
    def seen(c):
        v = F.col(c).cast("double")
        return F.when(F.abs(v) < F.lit(math.inf), v)

    def ends(c, sign):
        return F.count(F.when(F.col(c).cast("double") == F.lit(sign * math.inf), 1))

    stats = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.min(seen(c)).alias(f"lo{i}"), F.max(seen(c)).alias(f"hi{i}"), F.count(seen(c)).alias(f"n{i}"),
        F.approx_count_distinct(seen(c)).alias(f"u{i}"), ends(c, -1).alias(f"below{i}"), ends(c, 1).alias(f"above{i}"))]).first()
    want, bounds, distinct, rows = {}, {}, {}, {}
    for i, c in enumerate(cols):
        n, below = stats[f"n{i}"], stats[f"below{i}"]
        total = n + below + stats[f"above{i}"]
        if total:
            rows[c] = (total, below, n)
        if n:
            bounds[c] = (stats[f"lo{i}"], stats[f"hi{i}"], n)
            distinct[c] = stats[f"u{i}"]
            places = [r - below for p in probs for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))]
            want[c] = [r for r in places if 0 <= r < n]
    found = _order_stats(df.select(*want), want, bounds, distinct) if want else {}
    out: dict[str, list[float | None]] = {}

    def value(c, rank):
        total, below, n = rows[c]
        return -math.inf if rank < below else found[(c, rank - below)] if rank < below + n else math.inf

    for c in cols:
        if c not in rows:
            out[c] = [None] * len(probs)
            continue
        n = rows[c][0]
        out[c] = []
        for p in probs:
            pos = p * (n - 1)
            a, b, part = value(c, math.floor(pos)), value(c, math.ceil(pos)), pos - math.floor(pos)
            if part == 0.0 or a == b:
                out[c].append(a)
            elif math.isinf(b - a):  # infinite ends, or a distance beyond the largest double
                out[c].append(a * (1 - part) + b * part)
            else:
                out[c].append(a + (b - a) * part)
    return out
