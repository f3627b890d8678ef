"""Scores to ranks to consensus. Tables here have a row per method, run and feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def mean_abs_attribution(phi: DataFrame, feature: str = "feature", value: str = "phi", by=()) -> DataFrame:
    return phi.groupBy(*by, feature).agg(F.avg(F.abs(value)).alias("score"))


def max_rank(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Ascending rank within ``by``; ties share the largest rank, nulls come last, the lowest rank becomes 0."""
    w = W.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()).rangeBetween(W.unboundedPreceding, W.currentRow)
    ranked = scores.withColumn("rank", F.count(F.lit(1)).over(w).cast("double"))
    low = F.min("rank").over(W.partitionBy(*by))
    return ranked.withColumn("rank", F.when(F.col("rank") == low, 0.0).otherwise(F.col("rank")))


def consensus(ranks: DataFrame, feature: str = "feature", value: str = "rank") -> DataFrame:
    """Mean of the most frequent ranks of each feature, over all of them if several are equally frequent."""
    counts = ranks.groupBy(feature, value).agg(F.count("*").alias("n"))
    top = F.max("n").over(W.partitionBy(feature))
    return (counts.withColumn("top", top).where(F.col("n") == F.col("top"))
            .groupBy(feature).agg(F.avg(value).alias("score")))


def relevance_scores(attributions: DataFrame, method: str = "method", feature: str = "feature", value: str = "score") -> DataFrame:
    """Attribution matrix to consensus score, best first."""
    return consensus(max_rank(attributions, [method], value), feature).orderBy(F.desc("score"), feature)


def rank_stability(runs: DataFrame, feature: str = "feature", value: str = "rank") -> DataFrame:
    """Largest and mean rank over the runs and their ratio, near 1 where the runs agree."""
    return (runs.groupBy(feature).agg(F.max(value).alias("max_rank"), F.avg(value).alias("mean_rank"))
            .withColumn("ratio", F.when(F.col("max_rank") != 0, F.col("mean_rank") / F.col("max_rank")))
            .orderBy(F.desc("ratio"), feature))


def fdr_thresholds(w: DataFrame, fdr: float, by: list[str], value: str = "w") -> DataFrame:
    """Smallest t > 0 per group with (1 + #{W <= -t}) / max(1, #{W >= t}) <= fdr; null if there is none."""
    size = F.abs(value)
    down = W.partitionBy(*by).orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = w.withColumn("t", size).withColumns({
        "neg": F.sum((F.col(value) < 0).cast("int")).over(down), "pos": F.sum((F.col(value) > 0).cast("int")).over(down)})
    ok = (F.col("t") > 0) & ((1 + F.col("neg")) / F.greatest(F.lit(1), F.col("pos")) <= fdr)
    return counted.groupBy(*by).agg(F.min(F.when(ok, F.col("t"))).alias("threshold"))


def select_features(w: DataFrame, fdr: float, by: list[str], value: str = "w") -> DataFrame:
    """Add ``selected`` 0/1: the features whose statistic reaches the threshold of their group."""
    t = fdr_thresholds(w, fdr, by, value)
    return w.join(t, by).withColumn("selected", F.coalesce((F.col(value) >= F.col("threshold")).cast("int"), F.lit(0)))


def consolidate_runs(runs: DataFrame, feature: str = "feature", zero_selected: bool = True) -> DataFrame:
    """Majority flag, mean absolute statistic and rank score per feature over all runs, best first.

    ``runs``: feature, selected 0/1, w. With ``zero_selected`` the statistic of features whose flag is 1
    counts as 0 in the score, which is how the score has always been defined.
    """
    per = runs.groupBy(feature).agg(F.mode("selected", True).alias("selected"), F.avg(F.abs("w")).alias("w"))
    base = F.when(F.col("selected") == 1, 0.0).otherwise(F.col("w")) if zero_selected else F.col("w")
    scored = max_rank(per.withColumn("base", base).withColumn("one", F.lit(1)), ["one"], "base")
    return scored.select(feature, "selected", "w", F.col("rank").alias("score")).orderBy(F.desc("score"), feature)
