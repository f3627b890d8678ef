"""Incremental principal components from batches that arrive over time.

Each batch leaves one row of moments in a table, keyed by its number, so a repeated batch replaces its
own row. Every so many batches their rows are merged into a total, and the rows of the total before it are
deleted: what is stored and read stays bounded however long the stream runs, and the newest total can
always be made again, as a stream repeats no batch but its last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.gram import Moments
from ..operators.linear_dim import Projection, merge_moments, pca_from
from ..operators.matrix import matrix_moments, width

SCHEMA = "n double, mean array<double>, scatter array<double>, number bigint"
EVERY = 64


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    at, fs = _folder(spark, path)
    return spark.read.schema(SCHEMA).parquet(path) if fs.exists(at) else None


def _write(spark: SparkSession, mo: Moments, path: str, number: int) -> None:
    row = spark.createDataFrame([(float(mo.n), mo.mean.tolist(), mo.scatter.ravel().tolist(), number)], SCHEMA)
    row.drop("number").coalesce(1).write.mode("overwrite").parquet(f"{path}/number={number}")


def _merged(rows: DataFrame, total: Moments | None = None) -> Moments | None:
    """The sum of stored rows; the driver sees one d*d matrix at a time."""
    for r in rows.orderBy("number").toLocalIterator():
        d = len(r["mean"])
        mo = Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(d, d))
        total = mo if total is None else merge_moments([total, mo])
    return total


def _moments(spark: SparkSession, path: str, upto: int | None = None) -> tuple[Moments | None, int]:
    """Moments of all batches up to a number, from the newest total before it and what came later; and that total's number."""
    totals, batches = _stored(spark, f"{path}/totals"), _stored(spark, f"{path}/batches")
    total, last = None, -1
    if totals is not None:
        older = totals if upto is None else totals.where(totals["number"] < upto)
        last = max((r["number"] for r in older.select("number").collect()), default=-1)
        total = _merged(totals.where(totals["number"] == last))
    if batches is not None:
        new = batches["number"] > last
        total = _merged(batches.where(new if upto is None else new & (batches["number"] <= upto)), total)
    return total, last


def save_batch(m: DataFrame, batch: int, path: str, every: int = EVERY) -> None:
    """Store the moments of a batch ``key, x`` under its number; after every ``every`` batches, their total. A batch without rows stores none."""
    spark, d = m.sparkSession, width(m)
    if d:
        _write(spark, matrix_moments(m, d)[0], f"{path}/batches", batch)
    if (batch + 1) % every:
        return
    total, before = _moments(spark, path, batch)
    if total is None:
        return
    _write(spark, total, f"{path}/totals", batch)
    # the last total and the batches after it stay, should this batch be repeated
    for table, keep_from in (("batches", before + 1), ("totals", before)):
        at, fs = _folder(spark, f"{path}/{table}")
        for s in fs.listStatus(at) if fs.exists(at) else []:
            name = s.getPath().getName()
            if name.startswith("number=") and int(name[7:]) < keep_from:
                fs.delete(s.getPath(), True)


def merged_components(spark: SparkSession, path: str, k: int) -> Projection:
    """Principal components of all stored batches."""
    total, _ = _moments(spark, path)
    if total is None:
        raise ValueError("no batch with rows is stored")
    return pca_from(total, k)


def stream_moments(stream: DataFrame, path: str, checkpoint: str, every: int = EVERY):
    """Start a query that stores the moments of every micro-batch of a stream ``key, x``."""
    return (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda df, i: save_batch(df, i, path, every)).start())
