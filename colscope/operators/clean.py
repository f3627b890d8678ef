"""Cleaning: projections, sentinels, casts, encodings, merges, scaling and size reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.keys import below
from .order import with_position
from .profile import as_double, by_column, nan_percent, numeric_columns

# fixed values: texts that stand for "no value", and the text that does mean something
SENTINELS = ("", " ", "???????", "UNKNOWN", "nan", "NaN")
MEANINGFUL_NONE = "NONE"


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    return df if not columns or columns[0] == "All" else df.select(*columns)


def resolve_roles(df: DataFrame, keys=(), col_set=None) -> list[str]:
    """Data columns: the key columns are left out, a given column set wins, order as in the table."""
    chosen = set(col_set) if col_set is not None else set(df.columns) - set(keys)
    return [c for c in df.columns if c in chosen]


def exclude_names(names: list[str], spec: list[str]) -> list[str]:
    """``All``, a list of names, or ``!name`` entries that take names out."""
    out = {s[1:] for s in spec if s.startswith("!")}
    keep = [s for s in spec if not s.startswith("!") and s != "All"]
    return [n for n in names if n not in out and (not keep or n in keep)]


def numeric_only(df: DataFrame) -> DataFrame:
    """Numeric columns as double, booleans as 0/1."""
    return df.select(*[as_double(df, c).alias(c) for c in numeric_columns(df)])


def complete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=cols)


def bad_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with a null, NaN or infinite value; one row reaches the driver."""
    def bad(c):
        v = F.col(c).cast("double")
        return F.max((v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("int"))

    row = df.agg(*[bad(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[i]]


def drop_bad_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.drop(*bad_columns(df, cols or numeric_columns(df)))


def drop_sparse_columns(df: DataFrame, max_percent: float = 20.0) -> DataFrame:
    """Drop columns whose missing share is above the limit."""
    return df.drop(*[r["column"] for r in nan_percent(df).where(F.col("percent") > max_percent).collect()])


def clear_sentinels(df: DataFrame, cols: list[str] | None = None, sentinels=SENTINELS) -> DataFrame:
    """Sentinel texts become null; a padded ``NONE`` loses its padding and stays."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    marks = sorted({s.strip() for s in sentinels})

    def fix(c):
        t = F.trim(F.col(c))
        return F.when(t.isin(*marks), None).when(t == MEANINGFUL_NONE, t).otherwise(F.col(c))

    return df.withColumns({c: fix(c) for c in cols})


def bool_like_to_int(df: DataFrame, cols: list[str]) -> DataFrame:
    """Booleans and the texts True/False become 1/0; other texts become null."""
    def fix(c):
        t = F.lower(F.trim(F.col(c).cast("string")))
        return F.when(t == "true", 1).when(t == "false", 0).cast("int")

    return df.withColumns({c: fix(c) for c in cols})


def constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``column, is_constant``: a single value and no null, or nothing but nulls."""
    cols = cols or df.columns
    return by_column(df, cols, {"is_constant": lambda c: F.when(F.count(F.col(c)) == 0, True).otherwise(
        (F.min(F.col(c)) == F.max(F.col(c))) & (F.count(F.col(c)) == F.count("*")))})


def blank_constants(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    flat = [r["column"] for r in constant_columns(df, cols).where("is_constant").collect()]
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in flat})


def cast_roles(df: DataFrame, floats=(), ints=(), strings=()) -> DataFrame:
    """Casts by role; what does not parse becomes null instead of stopping the job."""
    def num(c, kind):
        return F.col(c).try_cast("double") if kind == "double" else F.col(c).try_cast("double").cast("long")

    new = {c: num(c, "double") for c in floats if c in df.columns}
    new |= {c: num(c, "long") for c in ints if c in df.columns}
    new |= {c: F.col(c).cast("string") for c in strings if c in df.columns}
    return df.withColumns(new)


def convert_types(df: DataFrame, floats=(), ints=(), strings=(), bools=()) -> DataFrame:
    """The whole clean-up in its usual order."""
    out = bool_like_to_int(df, [c for c in bools if c in df.columns])
    return cast_roles(clear_sentinels(blank_constants(out)), floats, ints, strings)


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Codes 0.. in sorted order of the values.

    Only distinct values are sorted. The code table is joined back without a hint, so the optimizer
    broadcasts it by its measured size and sort-merges it otherwise.
    """
    for c in cols:
        values = df.select(F.col(c).alias("__v")).where(F.col("__v").isNotNull()).distinct()
        codes = with_position(values, ["__v"], "__code")
        df = (df.join(codes, F.col(c) == F.col("__v"), "left")
              .withColumn(c, F.col("__code").cast("int")).drop("__v", "__code"))
    return df


def fill(df: DataFrame, value: float = -1) -> DataFrame:
    return df.fillna(value)


def categorize(names: DataFrame, mapping: list[tuple[str, list[str]]], column: str = "parameter") -> DataFrame:
    """Category of each name; a name listed under several categories takes the last one.

    The mapping is plan-time text of the caller, so it becomes a literal lookup and costs no join.
    """
    last = {n: cat for cat, members in mapping for n in members}
    if not last:
        return names.withColumn("category", F.lit(None).cast("string"))
    table = F.create_map(*[F.lit(x) for kv in last.items() for x in kv])
    return names.withColumn("category", F.try_element_at(table, F.col(column)))


def merge(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on)


def merge_report(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Key counts of a merge from one grouped pass: kept, lost on the left, lost on the right."""
    keys = (left.select(on, F.lit(1).alias("l"), F.lit(0).alias("r"))
            .unionByName(right.select(on, F.lit(0).alias("l"), F.lit(1).alias("r"))))
    per = keys.where(F.col(on).isNotNull()).groupBy(on).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.agg(
        F.sum(F.col("l") * F.col("r")).alias("kept"),
        F.sum(F.col("l") * (1 - F.col("r"))).alias("lost_left"),
        F.sum((1 - F.col("l")) * F.col("r")).alias("lost_right"))


def reduced_size(n: int, n_cols: int, floor: int = 250) -> int:
    """Rows the reduction aims at: all of a small table, else the larger of 5 per column and 8 %."""
    return n if n < floor else max(min(5 * n_cols, n), int(0.08 * n))


def reduce_rows(df: DataFrame, keys, seed: int = 1, n: int | None = None, n_cols: int | None = None) -> DataFrame:
    """Hash sample of the size of :func:`reduced_size`; the same rows whatever the partitioning."""
    n = df.count() if n is None else n
    goal = reduced_size(n, len(numeric_columns(df)) if n_cols is None else n_cols)
    return df if goal >= n else df.where(below(keys, goal / n, f"r{seed}"))


def thin_rows(df: DataFrame, keys, around: int = 2000, seed: int = 1, n: int | None = None) -> DataFrame:
    """One row in ``round(n / around)``, by hash instead of by position."""
    n = df.count() if n is None else n
    step = max(round(n / around), 1)
    return df if step == 1 else df.where(below(keys, 1 / step, f"t{seed}"))


def scaling_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column gets 1, as division by 0 is no use."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: list[str], stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(x - mean) / population std. Pass the statistics of the training rows to scale test rows alike."""
    stats = stats or scaling_stats(df, cols)
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in cols})


def scale_split(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    stats = scaling_stats(train, cols)
    return standardize(train, cols, stats), standardize(test, cols, stats)


def shift_to_positive(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add the size of the overall minimum to every column if any value is negative."""
    low = df.agg(F.least(*[F.min(c) for c in cols], F.lit(0.0)).alias("m")).first()["m"]
    return df if not low else df.withColumns({c: F.col(c) + F.lit(-low) for c in cols})


def log_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.ln(c) for c in cols})


def exp_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.exp(c) for c in cols})


def flatten_results(df: DataFrame, column: str) -> DataFrame:
    """Nested result lists as one row per inner result."""
    return df.withColumn(column, F.explode(F.flatten(column)))
