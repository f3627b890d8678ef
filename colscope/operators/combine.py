"""Which input columns are tried for which target columns."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession, functions as F

TUPLE_SCHEMA = "tuple_id int, inputs array<string>, outputs array<string>"


def _check(n: int, inputs: int, outputs: int, n_targets: int | None) -> None:
    if inputs + outputs > n:
        raise ValueError(f"{inputs} inputs and {outputs} outputs need more than the {n} columns there are")
    if n_targets is not None and outputs > n_targets:
        raise ValueError(f"{outputs} outputs wanted, but only {n_targets} targets given")


def count_combinations(all_cols, inputs: int, outputs: int, targets=None) -> int:
    n = len(all_cols)
    _check(n, inputs, outputs, len(targets) if targets else None)
    if targets:
        return comb(n - len(targets), inputs) * comb(len(targets), outputs)
    return comb(n, inputs) * comb(n - inputs, outputs)


def get_column_combinations(all_cols, inputs: int, outputs: int, targets=None, amount_only: bool = False,
                            return_targets: bool = False):
    """All (inputs, outputs) pairs of name tuples, or just their number.

    With targets, outputs come only from them and inputs only from the rest. Names are handled at plan
    time: their number is that of the schema, not of the data.
    """
    if amount_only:
        return count_combinations(all_cols, inputs, outputs, targets)
    _check(len(all_cols), inputs, outputs, len(targets) if targets else None)
    targets = list(targets or [])
    pool = [c for c in all_cols if c not in targets]
    pairs = []
    for ins in combinations(pool, inputs):
        for outs in combinations(targets or [c for c in pool if c not in ins], outputs):
            pairs.append((ins, outs))
    if not return_targets:
        return pairs
    return pairs, list(dict.fromkeys(outs for _, outs in pairs))


def tuples_frame(spark: SparkSession, pairs) -> DataFrame:
    return spark.createDataFrame([(i, list(a), list(b)) for i, (a, b) in enumerate(pairs)], TUPLE_SCHEMA)


def combination_coverage(df: DataFrame, pairs) -> DataFrame:
    """The tuples with the number of rows that are complete in all of their columns: one aggregate."""
    def complete(cols):
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.col(c).isNotNull()
        return F.sum(ok.cast("long"))

    flat = df.agg(*[complete(a + b).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(i).alias("tuple_id"), F.array(*map(F.lit, a)).alias("inputs"),
                     F.array(*map(F.lit, b)).alias("outputs"), F.col(f"n{i}").alias("n_complete"))
            for i, (a, b) in enumerate(pairs)]
    return flat.select(F.inline(F.array(*rows)))
