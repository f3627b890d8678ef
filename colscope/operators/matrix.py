"""Matrix form of a table: ``key, x ARRAY<DOUBLE>``, and row maps over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .gram import Moments, accumulate, moments


def as_matrix(df: DataFrame, key: str, cols: list[str] | str) -> DataFrame:
    """Columns, or one ready array column, as ``key BIGINT, x ARRAY<DOUBLE>``; incomplete rows are left out."""
    x = F.col(cols).cast("array<double>") if isinstance(cols, str) else F.array(*[F.col(c).cast("double") for c in cols])
    m = df.select(F.col(key).cast("long").alias("key"), x.alias("x"))
    return m.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def width(m: DataFrame) -> int:
    row = m.select(F.size("x").alias("d")).first()
    return row["d"] if row else 0


def _wide(m: DataFrame, d: int) -> tuple[DataFrame, list[str]]:
    cols = [f"c{i}" for i in range(d)]
    return m.select("key", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)]), cols


def matrix_moments(m: DataFrame, d: int, groups: int | None = None) -> list[Moments]:
    """Moments of the whole matrix, or of each of ``groups`` hash groups of its rows."""
    wide, cols = _wide(m, d)
    shift = np.zeros(d)
    group = None if groups is None else F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(groups))
    sums = accumulate(wide, cols, {"raw": shift}, group)["raw"]
    if groups is None and "all" in sums:
        first = moments([sums["all"]], shift, list(range(d)))[0]
        if np.any(np.abs(first.mean) > 1e3 * np.sqrt(np.maximum(np.diag(first.cov), 1e-300))):
            # far from the origin: take the sums again about the mean to keep their digits
            sums, shift = accumulate(wide, cols, {"raw": first.mean})["raw"], first.mean
    return [moments([p], shift, list(range(d)))[0] for _, p in sorted(sums.items())]


def map_rows(m: DataFrame, fn: Callable[[np.ndarray], np.ndarray], out: str = "y") -> DataFrame:
    """Add an array column computed from blocks of ``x``; ``fn`` maps (n, d) to (n, k)."""
    names = m.columns
    at = names.index("x")

    def run(batches):
        for b in batches:
            col = b.column(at)
            x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))
            y = np.ascontiguousarray(fn(x)) if len(col) else np.zeros((0, 1))
            k = y.shape[1]
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, len(col) * k + 1, k, dtype=np.int32)) if len(col) else
                                           pa.array([0], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, arr], [*names, out])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema.fields) + f", {out} array<double>"
    return m.mapInArrow(run, schema)


def packed(m: DataFrame, mean: np.ndarray) -> DataFrame:
    """The rows less ``mean`` as ``x BINARY`` of doubles: an array goes to Python value by value, bytes go as they are."""
    def run(batches):
        for b in batches:
            if len(b):
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) - mean
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    return m.select("x").mapInArrow(run, "x binary")


def unpacked(col: pa.Array, d: int) -> np.ndarray:
    """The (n, d) rows of a batch of ``packed``; a view of its bytes."""
    if not len(col):
        return np.zeros((0, d))
    _, offsets, data = col.buffers()
    start = np.frombuffer(offsets, np.int32, 1, 4 * col.offset)[0]
    return np.frombuffer(data, np.float64, len(col) * d, int(start)).reshape(-1, d)


def map_packed(rows: DataFrame, d: int, w: np.ndarray) -> DataFrame:
    """``y ARRAY<DOUBLE>``: packed rows times ``w``, in their order."""
    k = w.shape[1]

    def run(batches):
        for b in batches:
            y = np.ascontiguousarray(unpacked(b.column(0), d) @ w)
            at = pa.array(np.arange(0, len(b) * k + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(y.ravel()))], names=["y"])

    return rows.mapInArrow(run, "y array<double>")


def standardize_matrix(m: DataFrame, mo: Moments) -> DataFrame:
    """(x - mean) / population std; constant columns become 0."""
    sd = np.sqrt(np.diag(mo.scatter) / max(mo.n, 1))
    sd = np.where(sd > 0, sd, 1.0)
    return map_rows(m, lambda x: (x - mo.mean) / sd, "__x").select(
        *[F.col("__x").alias("x") if c == "x" else F.col(c) for c in m.columns])
