"""Column profiles of a table. Each is one or two aggregates whatever the number of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .quantiles import exact_quantiles

EXACT_IN_ONE_AGG = 200_000  # rows below which the built-in exact percentile is cheap


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def missing(df: DataFrame, c: str) -> Column:
    """Null, or NaN for floating columns."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def as_double(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, T.BooleanType):
        return F.col(c).cast("int").cast("double")
    return F.col(c).cast("double")


def by_column(df: DataFrame, cols: list[str], aggs: dict[str, callable]) -> DataFrame:
    """One aggregate over all columns, returned with a row per column.

    ``aggs`` maps an output name to ``name -> aggregate Column``. Only the one aggregated row is
    reshaped, never the table.
    """
    flat = df.agg(*[fn(c).alias(f"{k}__{i}") for i, c in enumerate(cols) for k, fn in aggs.items()])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                     *[F.col(f"{k}__{i}").alias(k) for k in aggs]) for i, c in enumerate(cols)]
    return flat.select(F.inline(F.array(*rows)))


def info(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of every column."""
    types = dict(df.dtypes)
    return by_column(df, df.columns, {"dtype": lambda c: F.lit(types[c]), "non_null": lambda c: F.count(F.col(c))})


def na_counts(df: DataFrame) -> DataFrame:
    return by_column(df, df.columns, {"n_missing": lambda c: F.sum(missing(df, c).cast("long"))})


def nan_percent(df: DataFrame, marker: str = "NaN") -> DataFrame:
    """Missing share in percent with one decimal; in text columns the marker text is what counts."""
    def share(c):
        text = isinstance(df.schema[c].dataType, T.StringType)
        gone = (F.coalesce(F.col(c) == marker, F.lit(False))) if text else missing(df, c)
        return F.round(100 * F.avg(gone.cast("double")), 1)

    return by_column(df, df.columns, {"percent": share})


def duplicated(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Values per column beyond the first of their kind; nulls count as equal to each other."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return by_column(df, df.columns, {
        "n_duplicated": lambda c: F.count("*") - distinct(F.col(c)) - F.max(F.col(c).isNull().cast("long"))})


def quantiles(df: DataFrame, cols: list[str], probs: list[float], approximate: bool = False) -> DataFrame:
    """``column, q ARRAY<DOUBLE>``. Exact by default: small tables in one aggregate, others by bracket search."""
    spark = df.sparkSession
    if approximate:
        return by_column(df, cols, {"q": lambda c: F.percentile_approx(as_double(df, c), F.lit(probs), 10_000)})
    if df.limit(EXACT_IN_ONE_AGG + 1).count() <= EXACT_IN_ONE_AGG:
        clean = lambda c: F.when(~missing(df, c), as_double(df, c))
        return by_column(df, cols, {"q": lambda c: F.percentile(clean(c), F.lit(probs))}).drop("position")
    found = exact_quantiles(df.select(*[as_double(df, c).alias(c) for c in cols]), cols, probs)
    return spark.createDataFrame([(c, found[c]) for c in cols], "column string, q array<double>")


def describe(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, sample standard deviation, extremes and quartiles of the numeric columns."""
    cols = cols or numeric_columns(df)
    seen = lambda c: F.when(~missing(df, c), as_double(df, c))
    base = by_column(df, cols, {
        "count": lambda c: F.count(seen(c)), "mean": lambda c: F.avg(seen(c)), "std": lambda c: F.stddev_samp(seen(c)),
        "min": lambda c: F.min(seen(c)), "max": lambda c: F.max(seen(c))})
    q = quantiles(df, cols, [0.25, 0.5, 0.75], approximate).select(
        "column", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"))
    return base.join(q, "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def moments_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct, missing, zero and negative counts and the first four moments of the numeric columns."""
    cols = cols or numeric_columns(df)
    v = lambda c: F.when(~missing(df, c), as_double(df, c))
    return by_column(df, cols, {
        "n": lambda c: F.count("*"), "n_distinct": lambda c: F.count_distinct(v(c)),
        "n_missing": lambda c: F.sum(missing(df, c).cast("long")),
        "n_zero": lambda c: F.sum(F.coalesce((v(c) == 0).cast("long"), F.lit(0))),
        "n_negative": lambda c: F.sum(F.coalesce((v(c) < 0).cast("long"), F.lit(0))),
        "mean": lambda c: F.avg(v(c)), "variance": lambda c: F.var_samp(v(c)),
        "skewness": lambda c: F.skewness(v(c)), "kurtosis": lambda c: F.kurtosis(v(c)),
        "min": lambda c: F.min(v(c)), "max": lambda c: F.max(v(c))})


def _long(df: DataFrame, cols: list[str], cast: str) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("v")) for c in cols])))


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width bins 1..bins per column, empty bins left out; the maximum falls in the last bin."""
    cols = cols or numeric_columns(df)
    ends = by_column(df, cols, {"lo": lambda c: F.min(as_double(df, c)), "hi": lambda c: F.max(as_double(df, c))})
    rows = _long(df, cols, "double").where(F.col("v").isNotNull() & ~F.isnan("v"))
    pos = F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1
    pos = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(pos, F.lit(bins)))
    # one row of ends per column name: bounded by the schema, so always broadcast
    return (rows.join(F.broadcast(ends), "column").groupBy("column", pos.cast("int").alias("bin"))
            .agg(F.count("*").alias("n")))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column as text, ties by value."""
    cols = cols or df.columns
    counts = _long(df, cols, "string").groupBy("column", "v").agg(F.count("*").alias("n"))
    # the rank filter is pushed below the shuffle, so each task sends at most k rows per column
    w = W.partitionBy("column").orderBy(F.desc("n"), F.col("v").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scale_status(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column whether it looks normalised, standard scaled or neither."""
    cols = cols or numeric_columns(df)
    v = lambda c: F.when(~missing(df, c), as_double(df, c))
    r = lambda x: F.bround(x, 1)
    per = by_column(df, cols, {"lo": lambda c: r(F.min(v(c))), "hi": lambda c: r(F.max(v(c))),
                               "mean1": lambda c: r(F.avg(v(c))), "std1": lambda c: r(F.stddev_pop(v(c)))})
    return per.select("column", F.when(F.col("hi") - F.col("lo") == 1, "NORMALIZED")
                      .when((F.col("mean1") == 0) & (F.col("std1") == 1), "STD_SCALED")
                      .otherwise("NOT_PREPROCESSED").alias("status"))


def scale_status_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The most frequent status and its share of the columns in whole percent."""
    order = {"NOT_PREPROCESSED": 0, "STD_SCALED": 1, "NORMALIZED": 2}
    per = scale_status(df, cols)
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("status")]
    # at most three rows are left here
    counts = per.groupBy("status").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return (counts.withColumn("percent", F.bround(100.0 * F.col("n") / total, 0))
            .orderBy(F.desc("n"), rank).limit(1).select("status", "percent"))


def preview(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*keys).limit(n)
