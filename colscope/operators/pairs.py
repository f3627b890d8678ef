"""Sums over all pairs of rows, exact and spread over tasks of bounded size.

Rows are hashed to blocks; each block is packed once, as one row of binary matrices, and sent once to every
pair of blocks that contains it. A group is one pair of blocks, at most two packed rows; it cuts them in
tiles, so that distance matrices stay small however large the blocks are, and returns sums per row, never
the pairs. Large blocks keep the copies few, and a group of rows gets as many blocks as its own size needs.
Work is quadratic, as the definition is; memory per task and output are not.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.keys import block

BLOCK_ROWS, BLOCK_BYTES = 24_576, 8 << 20  # a block holds neither more rows nor more bytes than about this
SPREAD_ROWS = 1_024  # blocks are not made smaller than this for the sake of more tasks
TILE = 256

Block = dict[str, np.ndarray]


def _row_bytes(df: DataFrame, cols: list[str]) -> int:
    """Packed bytes of a row; arrays are matrices, so the first row tells their widths."""
    sizes = [F.size(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.lit(1) for c in cols]
    first = df.select(sum(sizes, F.lit(0)).alias("w")).first()
    return 8 * max(first["w"] if first else 1, 1)


def _largest_block(df: DataFrame, cols: list[str]) -> int:
    return max(min(BLOCK_ROWS, BLOCK_BYTES // _row_bytes(df, cols)), 256)


def pair_sums(df: DataFrame, fn: Callable[[Block, Block], Block], sums: list[str], n: int | str, gid: str | None = None,
              key: str = "key", block_rows: int | None = None, tile: int = TILE) -> DataFrame:
    """Per row (gid, key): the columns ``sums`` added up over all partner rows of its group, itself included.

    ``n`` is the number of rows, or the column that holds the number of rows of the row's group. Keys are unique
    in a group; the other columns are numbers or arrays of one width. ``fn(rows, partners)`` gets them as vectors
    and matrices and returns a vector per sum, in the order of ``rows``. An empty table gives no rows.
    """
    spark = df.sparkSession
    cols = [c for c in df.columns if c not in (gid, key, n)]
    arrays = [c for c in cols if isinstance(df.schema[c].dataType, T.ArrayType)]
    slots = spark.sparkContext.defaultParallelism
    rows = F.col(n) if isinstance(n, str) else F.lit(n)
    if block_rows:
        count = F.ceil(rows / block_rows)
    else:
        count = F.greatest(F.ceil(rows / _largest_block(df, cols)), F.least(F.ceil(rows / SPREAD_ROWS), F.lit(math.ceil(math.sqrt(4 * slots)))))
    own = df.select(
        (F.col(gid) if gid else F.lit(0)).cast("int").alias("__gid"), F.greatest(count, F.lit(1)).cast("int").alias("__blocks"),
        F.col(key), *[F.col(c).cast("array<double>" if c in arrays else "double").alias(c) for c in cols])
    own = own.withColumn("__b", block(key, F.col("__blocks")))
    key_type = df.schema[key].dataType.simpleString()

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by(key).combine_chunks()
        out = {c: t[c][:1] for c in ("__gid", "__blocks", "__b")}
        out["__keys"] = pa.array([t[key].to_pylist()], pa.list_(t[key].type))
        for c in cols:
            flat = pa.concat_arrays(t[c].chunks)
            flat = flat.flatten() if c in arrays else flat
            out[c] = pa.array([flat.to_numpy(zero_copy_only=False).astype(float).tobytes()], pa.binary())
        return pa.table(out)

    packed = own.groupBy("__gid", "__blocks", "__b").applyInArrow(
        pack, f"__gid int, __blocks int, __b int, __keys array<{key_type}>" + "".join(f", `{c}` binary" for c in cols))
    sent = (packed.withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
            .withColumns({"__lo": F.least("__b", "__c"), "__hi": F.greatest("__b", "__c")}).drop("__c", "__blocks"))
    if isinstance(n, str) or n > SPREAD_ROWS:
        # little data, much work: partitions by number, which are not put together for being small
        sent = sent.repartition(4 * slots, "__gid", "__lo", "__hi")

    def work(t: pa.Table) -> pa.Table:
        held, keys = {}, {}
        for r in t.to_pylist():
            size = len(r["__keys"])
            keys[r["__b"]] = r["__keys"]
            held[r["__b"]] = {c: np.frombuffer(r[c]).reshape((size, -1) if c in arrays else (size,)) for c in cols}
        lo, hi = t["__lo"][0].as_py(), t["__hi"][0].as_py()
        out_keys, out = [], {c: [] for c in sums}
        for i, j in [(lo, hi)] if lo == hi else [(lo, hi), (hi, lo)]:
            if i not in held or j not in held:
                continue
            size, partners = len(keys[i]), len(keys[j])
            total = {c: np.zeros(size) for c in sums}
            for s in range(0, size, tile):
                here = {c: v[s:s + tile] for c, v in held[i].items()}
                for p in range(0, partners, tile):
                    got = fn(here, {c: v[p:p + tile] for c, v in held[j].items()})
                    for c in sums:
                        total[c][s:s + tile] += got[c]
            out_keys += keys[i]
            for c in sums:
                out[c].append(total[c])
        data = {"__gid": pa.array(np.full(len(out_keys), t["__gid"][0].as_py()), pa.int32()),
                key: pa.array(out_keys, t.schema.field("__keys").type.value_type)}
        data.update({c: pa.array(np.concatenate(out[c]) if out[c] else np.zeros(0), pa.float64()) for c in sums})
        return pa.table(data)

    schema = f"__gid int, `{key}` {key_type}, " + ", ".join(f"{c} double" for c in sums)
    parts = sent.groupBy("__gid", "__lo", "__hi").applyInArrow(work, schema)
    out = parts.groupBy("__gid", key).agg(*[F.sum(c).alias(c) for c in sums])
    return out.withColumnRenamed("__gid", gid) if gid else out.drop("__gid")
