"""Positions in a global sort order without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut

UNHASHED = ("map<", "variant", "void")
LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in these bits


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based position of each row in the order of ``order``; rows with equal keys follow by a hash of all columns.

    The hash makes the numbering repeatable up to rows that are equal throughout, and lets the range partitions split
    a key that very many rows have. Rows are range partitioned and sorted, each remembers its place in its partition, and the number
    of rows before each partition is added: one row per partition is all that is gathered.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if not any(u in kind for u in UNHASHED)]
    order = [*order, "__tie"]
    placed = cut(df.withColumn("__tie", F.xxhash64(*rest)).repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
                 .withColumns({"__part": F.spark_partition_id(), "__local": local}), "order")
    w = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = (placed.groupBy("__part").agg(F.count("*").alias("__n"))
              .select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before")))
    # one row per partition of the sort
    return (placed.join(F.broadcast(before), "__part")
            .withColumn(name, F.col("__before") + F.col("__local")).drop("__part", "__local", "__before"))
