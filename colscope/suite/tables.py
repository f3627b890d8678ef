"""Registered queries on sources, cleaning, profiles, joins, sorting and aggregates."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.keys import is_test
from ..operators import clean as C, combine as K, models as MD, profile as P, ranking as R
from ..operators.dcor import distance_correlation
from ..operators.quantiles import exact_quantiles
from ..plans import complexity as CX
from ..sources import tables as S
from ..session import scratch_path
from .common import query, rounded, sql_below, table, union_all

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


# ---- sources and sinks -------------------------------------------------------------------------

@query("csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf):
    src = table(spark, sf, "customer")
    path = scratch_path(spark, "csv")
    S.write_csv(src, path)
    got = S.read_csv(spark, path)
    return got.select(*[F.col(f.name).cast(f.dataType) for f in src.schema.fields])


@query("csv_scan_floats", "SELECT CAST(l_quantity AS DOUBLE) l_quantity, CAST(l_linenumber AS DOUBLE) l_linenumber, "
       "count(*) n, round(sum(l_extendedprice), 2) total FROM lineitem GROUP BY 1, 2")
def csv_scan_floats(spark, sf):
    path = scratch_path(spark, "csv")
    S.write_csv(table(spark, sf, "lineitem").select("l_quantity", "l_linenumber", "l_extendedprice"), path)
    got = S.read_csv_floats(spark, path, ["l_quantity", "l_linenumber", "l_extendedprice"])
    return got.groupBy("l_quantity", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("csv_many_files", "SELECT l_returnflag, l_linenumber AS run, count(*) AS n, round(sum(l_quantity), 4) AS qty, true AS has_file "
       "FROM lineitem GROUP BY 1, 2")
def csv_many_files(spark, sf):
    """Per-run files with semicolons, read back as one scan that knows each row's file."""
    path = scratch_path(spark, "runs")
    S.write_runs(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.col("l_linenumber").alias("run")), path)
    got = S.read_many_csv(spark, path, schema="l_returnflag string, l_quantity double, run int")
    return got.groupBy("l_returnflag", "run").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"),
                                                 F.min(F.col("file").endswith(".csv")).alias("has_file"))


@query("model_roundtrip", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a FROM lineitem) "
       "SELECT l_quantity, count(*) n, round(avg(a + b * l_quantity), 3) AS prediction FROM lineitem, m GROUP BY 1")
def model_roundtrip(spark, sf):
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label")))
    path = scratch_path(spark, "model")
    S.save_model(LinearRegression(solver="normal").fit(rows), path)
    got = S.load_model(path).transform(rows)
    return got.groupBy("l_quantity").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 3).alias("prediction"))


# ---- projection, cleaning ----------------------------------------------------------------------

@query("project", "SELECT o_orderkey, o_totalprice FROM orders")
def project(spark, sf):
    return C.project(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])


@query("roles", "SELECT o_orderstatus, o_totalprice FROM orders")
def roles(spark, sf):
    df = table(spark, sf, "orders")
    cols = C.resolve_roles(df, ["o_orderkey"], ["o_totalprice", "o_orderstatus", "o_totalprice"])
    return df.select(*cols)


@query("numeric_only", "SELECT CAST(o_orderkey AS DOUBLE) o_orderkey, CAST(o_custkey AS DOUBLE) o_custkey, o_totalprice FROM orders")
def numeric_only(spark, sf):
    return C.numeric_only(table(spark, sf, "orders"))


HOLES = ("SELECT l_orderkey, nullif(l_linenumber, 7) AS a, CASE WHEN l_discount > 0.02 THEN l_discount END AS b, l_tax AS c, "
         "l_quantity AS d FROM lineitem")


def holes(spark, sf):
    """lineitem with planted nulls: a few in ``a``, many in ``b``, none in ``c`` and ``d``."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("a"),
                     F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("b"), F.col("l_tax").alias("c"), F.col("l_quantity").alias("d"))


@query("complete_rows", f"SELECT a, b, count(*) n FROM ({HOLES}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2")
def complete_rows(spark, sf):
    return C.complete_rows(holes(spark, sf), ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("drop_bad_columns", f"SELECT l_orderkey, c, d FROM ({HOLES})")
def drop_bad_columns(spark, sf):
    return C.drop_bad_columns(holes(spark, sf))


@query("drop_named", f"SELECT c, d FROM ({HOLES})")
def drop_named(spark, sf):
    return holes(spark, sf).drop("l_orderkey", "a", "b")


@query("drop_sparse_columns", f"SELECT l_orderkey, a, c, d FROM ({HOLES})")
def drop_sparse_columns(spark, sf):
    return C.drop_sparse_columns(holes(spark, sf), 20.0)


@query("nan_percent", f"WITH h AS ({HOLES}) " + union_all(
    [f"SELECT '{c}' AS \"column\", {i} AS position, round(100 * avg(CAST({c} IS NULL AS INTEGER)), 1) AS percent FROM h"
     for i, c in enumerate(["l_orderkey", "a", "b", "c", "d"])]))
def nan_percent(spark, sf):
    return P.nan_percent(holes(spark, sf))


@query("merge_complete", "SELECT c_custkey, nullif(c_nationkey, 3) AS nk, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey "
       "WHERE nullif(c_nationkey, 3) IS NOT NULL")
def merge_complete(spark, sf):
    """Rows with any null are dropped after the merge."""
    c = table(spark, sf, "customer").withColumn("k", F.col("c_nationkey"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    both = C.merge(c, n, "k").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nk"), "n_name", "c_acctbal")
    return C.complete_rows(both)


DIRTY = ("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'UNKNOWN   ' WHEN '2-HIGH' THEN 'NONE      ' WHEN '3-MEDIUM' THEN ' ' "
         "ELSE o_orderpriority END AS txt, CASE WHEN o_orderstatus = 'O' THEN 'True' WHEN o_orderstatus = 'F' THEN 'False' ELSE '???????' END AS flag, "
         "'x' AS same, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS num FROM orders")


def dirty(spark, sf):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(p == "1-URGENT", "UNKNOWN   ").when(p == "2-HIGH", "NONE      ").when(p == "3-MEDIUM", " ").otherwise(p).alias("txt"),
        F.when(s == "O", "True").when(s == "F", "False").otherwise("???????").alias("flag"), F.lit("x").alias("same"),
        F.when(s == "P", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("num"))


CLEAN_TXT = "CASE WHEN trim(txt) IN ('', '???????', 'UNKNOWN', 'nan', 'NaN') THEN NULL WHEN trim(txt) = 'NONE' THEN 'NONE' ELSE txt END"


@query("sentinels", f"SELECT o_orderkey, {CLEAN_TXT} AS txt, CASE WHEN flag <> '???????' THEN flag END AS flag FROM ({DIRTY})")
def sentinels(spark, sf):
    return C.clear_sentinels(dirty(spark, sf), ["txt", "flag"]).select("o_orderkey", "txt", "flag")


@query("bool_like", f"SELECT o_orderkey, CASE flag WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS flag FROM ({DIRTY})")
def bool_like(spark, sf):
    return C.bool_like_to_int(dirty(spark, sf), ["flag"]).select("o_orderkey", "flag")


@query("constant_columns", f"WITH h AS ({DIRTY}) " + union_all(
    [f"SELECT '{c}' AS \"column\", {i} AS position, count(DISTINCT {c}) = 1 AND count({c}) = count(*) AS is_constant FROM h"
     for i, c in enumerate(["o_orderkey", "txt", "flag", "same", "num"])]))
def constant_columns(spark, sf):
    return C.constant_columns(dirty(spark, sf))




@query("cast_roles", f"SELECT CAST(o_orderkey AS DOUBLE) o_orderkey, try_cast(num AS BIGINT) AS num FROM ({DIRTY})")
def cast_roles(spark, sf):
    return C.cast_roles(dirty(spark, sf), floats=["o_orderkey"], ints=["num"]).select("o_orderkey", "num")


@query("convert_types", f"SELECT o_orderkey, {CLEAN_TXT} AS txt, CASE flag WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS flag, CAST(NULL AS VARCHAR) AS same, "
       f"try_cast(num AS DOUBLE) AS num FROM ({DIRTY})")
def convert_types(spark, sf):
    return C.convert_types(dirty(spark, sf), floats=["num"], ints=["o_orderkey"], strings=["txt"], bools=["flag"])


@query("label_encode", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name, "
       "CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment FROM customer")
def label_encode(spark, sf):
    return C.label_encode(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"])


@query("fill", f"SELECT l_orderkey, coalesce(a, -1) a, coalesce(b, -1) b, c, d FROM ({HOLES})")
def fill(spark, sf):
    return C.fill(holes(spark, sf))


CATEGORIES = [("metal", ["BRASS", "COPPER", "NICKEL", "STEEL", "TIN"]), ("alloy", ["BRASS", "STEEL"])]


@query("category_lookup", "SELECT p_partkey, CASE WHEN m IN ('BRASS', 'STEEL') THEN 'alloy' WHEN m IN ('COPPER', 'NICKEL', 'TIN') THEN 'metal' END AS category "
       "FROM (SELECT p_partkey, list_extract(string_split(p_type, ' '), -1) AS m FROM part)")
def category_lookup(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", F.element_at(F.split("p_type", " "), -1).alias("parameter"))
    return C.categorize(names, CATEGORIES).drop("parameter")


@query("merge_report", "WITH c AS (SELECT DISTINCT c_custkey k FROM customer), o AS (SELECT DISTINCT o_custkey k FROM orders) SELECT "
       "(SELECT count(*) FROM c JOIN o USING (k)) AS kept, (SELECT count(*) FROM c ANTI JOIN o USING (k)) AS lost_left, "
       "(SELECT count(*) FROM o ANTI JOIN c USING (k)) AS lost_right")
def merge_report(spark, sf):
    return C.merge_report(table(spark, sf, "customer").withColumnRenamed("c_custkey", "k"),
                          table(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), "k")


@query("reduce_rows", "WITH s AS (SELECT count(*) n FROM orders) SELECT o_orderkey FROM orders, s WHERE "
       "substr(md5(concat_ws(':', 'r1', CAST(o_orderkey AS VARCHAR))), 1, 8) < "
       "printf('%08x', CAST(floor(greatest(least(15, n), floor(0.08 * n)) / n * 4294967296) AS BIGINT))")
def reduce_rows(spark, sf):
    return C.reduce_rows(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey")


@query("thin_rows", "WITH s AS (SELECT greatest(round(count(*) / 2000.0), 1) step FROM orders) SELECT o_orderkey FROM orders, s WHERE step = 1 OR "
       "substr(md5(concat_ws(':', 't1', CAST(o_orderkey AS VARCHAR))), 1, 8) < printf('%08x', CAST(floor(4294967296 / step) AS BIGINT))")
def thin_rows(spark, sf):
    return C.thin_rows(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey")


@query("standardize", "SELECT o_orderkey, round((o_totalprice - m1) / s1, 6) o_totalprice, round((o_custkey - m2) / s2, 6) o_custkey FROM orders, "
       "(SELECT avg(o_totalprice) m1, stddev_pop(o_totalprice) s1, avg(o_custkey) m2, stddev_pop(o_custkey) s2 FROM orders)")
def standardize(spark, sf):
    return rounded(C.standardize(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"]))


SCALED = ("SELECT (l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem) AS a, "
          "(l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem) AS b, l_extendedprice AS c, l_linenumber AS d FROM lineitem")


def scaled_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    lo, hi, m, s = li.agg(F.min("l_quantity"), F.max("l_quantity"), F.avg("l_tax"), F.stddev_pop("l_tax")).first()
    return li.select(((F.col("l_quantity") - lo) / (hi - lo)).alias("a"), ((F.col("l_tax") - m) / s).alias("b"),
                     F.col("l_extendedprice").alias("c"), F.col("l_linenumber").alias("d"))


STATUS = union_all([f"SELECT '{c}' AS \"column\", CASE WHEN round(max({c}), 1) - round(min({c}), 1) = 1 THEN 'NORMALIZED' WHEN round(avg({c}), 1) = 0 "
                    f"AND round(stddev_pop({c}), 1) = 1 THEN 'STD_SCALED' ELSE 'NOT_PREPROCESSED' END AS status FROM h" for c in "abcd"])


@query("scale_status", f"WITH h AS ({SCALED}) {STATUS}")
def scale_status(spark, sf):
    return P.scale_status(scaled_columns(spark, sf))


@query("scale_status_summary", f"WITH h AS ({SCALED}), s AS ({STATUS}) SELECT status, CAST(round(100.0 * count(*) / 4, 0) AS DOUBLE) AS percent FROM s "
       "GROUP BY status ORDER BY count(*) DESC LIMIT 1")
def scale_status_summary(spark, sf):
    return P.scale_status_summary(scaled_columns(spark, sf)).withColumn("percent", F.col("percent").cast("double"))


@query("shift_to_positive", "SELECT c_custkey, round(c_acctbal + (SELECT greatest(-min(least(c_acctbal, c_nationkey)), 0) FROM customer), 4) AS c_acctbal, "
       "round(c_nationkey + (SELECT greatest(-min(least(c_acctbal, c_nationkey)), 0) FROM customer), 4) AS c_nationkey FROM customer")
def shift_to_positive(spark, sf):
    return rounded(C.shift_to_positive(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"]), 4)


@query("log_transform", "SELECT o_orderkey, round(ln(o_totalprice), 6) AS o_totalprice, round(exp(ln(o_totalprice)), 4) AS back FROM orders")
def log_transform(spark, sf):
    logs = C.log_columns(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    back = C.exp_columns(logs.withColumn("back", F.col("o_totalprice")), ["back"])
    return back.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), F.round("back", 4).alias("back"))


# ---- profiles ----------------------------------------------------------------------------------

INFO_TYPES = {"l_orderkey": "bigint", "a": "int", "b": "double", "c": "double", "d": "double"}


@query("info", f"WITH h AS ({HOLES}) " + union_all(
    [f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, count({c}) AS non_null FROM h" for i, (c, t) in enumerate(INFO_TYPES.items())]))
def info(spark, sf):
    return P.info(holes(spark, sf))


def _describe_sql(cols):
    return union_all([f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
                      f"CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, "
                      f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM h" for c in cols])


@query("describe", f"WITH h AS ({HOLES}) " + _describe_sql(["a", "b", "c", "d"]))
def describe(spark, sf):
    return rounded(P.describe(holes(spark, sf), ["a", "b", "c", "d"]))


WILD = "SELECT CASE WHEN l_orderkey % 50 = 0 THEN {inf} WHEN l_orderkey % 50 = 1 THEN -{inf} WHEN l_orderkey % 50 = 2 THEN 1e300 * l_extendedprice ELSE l_extendedprice END AS v FROM lineitem"


@query("quantiles_infinite", f"SELECT round(quantile_cont(v, 0.25), 5) AS q1, round(quantile_cont(v, 0.5), 5) AS q2, round(quantile_cont(v, 0.75), 5) AS q3 FROM ({WILD.format(inf="CAST('inf' AS DOUBLE)")})")
def quantiles_infinite(spark, sf):
    """Quartiles of a column with infinities and a range beyond the largest double."""
    o, p = F.col("l_orderkey") % 50, F.col("l_extendedprice")
    v = F.when(o == 0, F.lit(float("inf"))).when(o == 1, F.lit(float("-inf"))).when(o == 2, p * F.lit(1e300)).otherwise(p)
    got = exact_quantiles(table(spark, sf, "lineitem").select(v.alias("v")), ["v"], [0.25, 0.5, 0.75])["v"]
    return spark.createDataFrame([tuple(round(q, 5) for q in got)], "q1 double, q2 double, q3 double")


@query("column_stats", "WITH h AS (SELECT * FROM lineitem) " + union_all(
    [f"SELECT '{c}' AS \"column\", round(avg({c}), 5) mean, round(stddev_pop({c}), 5) std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM h" for c in NUM]))
def column_stats(spark, sf):
    li = table(spark, sf, "lineitem")
    got = P.by_column(li, NUM, {"mean": F.avg, "std": F.stddev_pop, "min": lambda c: F.min(F.col(c).cast("double")), "max": lambda c: F.max(F.col(c).cast("double"))})
    return rounded(got.drop("position"), 5)


@query("na_counts", f"WITH h AS ({HOLES}) " + union_all(
    [f"SELECT '{c}' AS \"column\", {i} AS position, CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM h" for i, c in enumerate(["l_orderkey", "a", "b", "c", "d"])]))
def na_counts(spark, sf):
    return P.na_counts(holes(spark, sf))


@query("duplicated", f"WITH h AS ({HOLES}) " + union_all(
    [f"SELECT '{c}' AS \"column\", {i} AS position, CAST(count(*) - count(DISTINCT {c}) - max(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS n_duplicated FROM h"
     for i, c in enumerate(["l_orderkey", "a", "b", "c", "d"])]))
def duplicated(spark, sf):
    return P.duplicated(holes(spark, sf))


@query("profile", f"WITH h AS ({HOLES}) " + union_all(
    [f"SELECT '{c}' AS \"column\", count(*) AS n, count(DISTINCT {c}) AS n_distinct, CAST(count(*) - count({c}) AS BIGINT) AS n_missing, CAST(sum(CAST(coalesce({c} = 0, false) AS INTEGER)) AS BIGINT) AS n_zero, "
     f"CAST(sum(CAST(coalesce({c} < 0, false) AS INTEGER)) AS BIGINT) AS n_negative, round(avg({c}), 5) AS mean, round(var_samp({c}), 5) AS variance, "
     f"round(avg(power({c} - m, 3)) / power(stddev_pop({c}), 3), 5) AS skewness, round(avg(power({c} - m, 4)) / power(var_pop({c}), 2) - 3, 5) AS kurtosis, "
     f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM h, (SELECT avg({c}) AS m FROM h)" for c in ["a", "b", "c", "d"]]))
def profile(spark, sf):
    return rounded(P.moments_profile(holes(spark, sf), ["a", "b", "c", "d"]).drop("position"), 5)


@query("histogram", "WITH h AS (SELECT * FROM lineitem) " + union_all(
    [f"SELECT '{c}' AS \"column\", CAST(least(floor(({c} - lo) * 10 / (hi - lo)) + 1, 10) AS INTEGER) AS bin, count(*) AS n FROM h, (SELECT min({c}) lo, max({c}) hi FROM h) GROUP BY 1, 2"
     for c in ["l_quantity", "l_extendedprice"]]))
def histogram(spark, sf):
    return P.histogram(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("top_values", "SELECT * FROM (SELECT 'l_returnflag' AS \"column\", l_returnflag AS v, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS INTEGER) AS rank FROM lineitem GROUP BY 2 "
       "UNION ALL SELECT 'l_orderkey', CAST(l_orderkey AS VARCHAR), count(*), CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(l_orderkey AS VARCHAR)) AS INTEGER) FROM lineitem GROUP BY 2) WHERE rank <= 10")
def top_values(spark, sf):
    return P.top_values(table(spark, sf, "lineitem"), ["l_returnflag", "l_orderkey"])


@query("preview", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, sf):
    return P.preview(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 5)


# ---- combinations ------------------------------------------------------------------------------

def _coverage_pairs():
    return K.get_column_combinations(["a", "b", "c", "d"], 2, 1, ["d"])


@query("combinations", f"WITH h AS ({HOLES}) " + union_all(
    [f"SELECT {i} AS tuple_id, '{'+'.join(a)}' AS inputs, '{b[0]}' AS outputs, CAST(sum(CAST({' AND '.join(f'{c} IS NOT NULL' for c in (*a, *b))} AS INTEGER)) AS BIGINT) AS n_complete FROM h"
     for i, (a, b) in enumerate(_coverage_pairs())]))
def combinations(spark, sf):
    got = K.combination_coverage(holes(spark, sf), _coverage_pairs())
    return got.select("tuple_id", F.concat_ws("+", "inputs").alias("inputs"), F.concat_ws("+", "outputs").alias("outputs"), "n_complete")


@query("combination_count", f"SELECT CAST(6 AS BIGINT) AS amount, count(*) AS n_rows FROM ({HOLES})")
def combination_count(spark, sf):
    df = holes(spark, sf)
    n = K.get_column_combinations(["a", "b", "c", "d"], 2, 1, ["d"], amount_only=True) + K.count_combinations(["a", "b", "c"], 2, 1)
    return df.agg(F.lit(n).cast("long").alias("amount"), F.count("*").alias("n_rows"))


# ---- joins, sets, sorting ----------------------------------------------------------------------

# a rank per (run, feature) derived from lineitem: the run is the line number, the feature a brand
RUNS = ("SELECT l_linenumber AS run, p_brand AS feature, round(avg(l_extendedprice * (1 - l_discount)) - 36000, 4) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")


def runs(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return (li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("l_linenumber").alias("run"), F.col("p_brand").alias("feature"))
            .agg(F.round(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))) - 36000, 4).alias("w")))


MAX_RANK = ("SELECT run, feature, CASE WHEN r = min(r) OVER (PARTITION BY run) THEN 0 ELSE r END AS rank FROM (SELECT run, feature, CAST(count(*) OVER (PARTITION BY run ORDER BY w NULLS LAST "
            f"RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS r FROM ({RUNS}))")


@query("max_rank", MAX_RANK)
def max_rank(spark, sf):
    return R.max_rank(runs(spark, sf), ["run"], "w").select("run", "feature", "rank")


@query("rank_join", f"WITH r AS ({MAX_RANK}), a AS (SELECT feature, max(rank) AS max_rank FROM r GROUP BY 1), b AS (SELECT feature, round(avg(rank), 6) AS mean_rank FROM r GROUP BY 1) "
       "SELECT * FROM a JOIN b USING (feature)")
def rank_join(spark, sf):
    r = max_rank(spark, sf)
    a = r.groupBy("feature").agg(F.max("rank").alias("max_rank"))
    return a.join(r.groupBy("feature").agg(F.round(F.avg("rank"), 6).alias("mean_rank")), "feature")


@query("rank_stability", f"SELECT feature, max(rank) AS max_rank, round(avg(rank), 6) AS mean_rank, round(avg(rank) / nullif(max(rank), 0), 6) AS ratio FROM ({MAX_RANK}) GROUP BY 1")
def rank_stability(spark, sf):
    return rounded(R.rank_stability(max_rank(spark, sf)))


@query("consensus", f"WITH c AS (SELECT feature, rank, count(*) AS n FROM ({MAX_RANK}) GROUP BY 1, 2) SELECT feature, round(avg(rank), 6) AS score FROM "
       "(SELECT *, max(n) OVER (PARTITION BY feature) AS top FROM c) WHERE n = top GROUP BY 1")
def consensus(spark, sf):
    return rounded(R.relevance_scores(runs(spark, sf), "run", "feature", "w"))


@query("mean_abs", f"SELECT feature, round(avg(abs(w)), 6) AS score FROM ({RUNS}) GROUP BY 1")
def mean_abs(spark, sf):
    return rounded(R.mean_abs_attribution(runs(spark, sf), value="w"))


FDR = (f"SELECT run, min(t) AS threshold FROM (SELECT a.run, abs(a.w) AS t, sum(CASE WHEN b.w <= -abs(a.w) THEN 1 ELSE 0 END) AS neg, sum(CASE WHEN b.w >= abs(a.w) THEN 1 ELSE 0 END) AS pos "
       f"FROM ({RUNS}) a JOIN ({RUNS}) b ON a.run = b.run WHERE a.w <> 0 GROUP BY a.run, a.feature, abs(a.w)) WHERE (1 + neg) / greatest(1, pos) <= 0.3 GROUP BY run")


@query("fdr_threshold", f"SELECT r.run, threshold FROM (SELECT DISTINCT l_linenumber AS run FROM lineitem) r LEFT JOIN ({FDR}) f ON r.run = f.run")
def fdr_threshold(spark, sf):
    return R.fdr_thresholds(runs(spark, sf), 0.3, ["run"])


FLAGGED = f"SELECT r.run, feature, w, coalesce(CAST(w >= threshold AS INTEGER), 0) AS selected FROM ({RUNS}) r LEFT JOIN ({FDR}) f ON r.run = f.run"


@query("knockoff_consolidate", f"WITH p AS (SELECT feature, CASE WHEN 2 * sum(selected) > count(*) THEN 1 ELSE 0 END AS selected, avg(abs(w)) AS w FROM ({FLAGGED}) GROUP BY 1), "
       "b AS (SELECT *, CASE WHEN selected = 1 THEN 0 ELSE w END AS base FROM p), k AS (SELECT *, count(*) OVER (ORDER BY base RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM b) "
       "SELECT feature, selected, round(w, 6) AS w, CAST(CASE WHEN r = min(r) OVER () THEN 0 ELSE r END AS DOUBLE) AS score FROM k")
def knockoff_consolidate(spark, sf):
    flagged = R.select_features(runs(spark, sf), 0.3, ["run"])
    return rounded(R.consolidate_runs(flagged))


@query("mode_flag", f"SELECT feature, CASE WHEN 2 * sum(selected) > count(*) THEN 1 ELSE 0 END AS flag FROM ({FLAGGED}) GROUP BY 1")
def mode_flag(spark, sf):
    return R.select_features(runs(spark, sf), 0.3, ["run"]).groupBy("feature").agg(F.mode("selected", True).alias("flag"))


@query("union_runs", "SELECT 'orders' AS run, o_custkey AS k, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'customer', c_custkey, 1 FROM customer")
def union_runs(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("run", F.lit("orders"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).cast("long").alias("n"), F.lit("customer").alias("run"))
    return o.unionByName(c).select("run", "k", "n")


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(
        table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("column_bind", "SELECT o_orderkey, round(o_totalprice / 1000, 6) AS p1, round(o_custkey * 2.5, 6) AS p2 FROM orders")
def column_bind(spark, sf):
    """Predictions of two models side by side, as the upper model of a stack sees them."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.array(F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double")).alias("x")).withColumn("features", F.col("x"))
    base = [MD.FittedModel(n, {}, False, SQLTransformer(statement=f"SELECT *, {e} AS prediction FROM __THIS__")) for n, e in (("price", "x[0] / 1000"), ("customer", "x[1] * 2.5"))]
    got = MD.stack_features(rows, base)
    return got.select(F.col("key").alias("o_orderkey"), *[F.round(F.col("x")[i], 6).alias(f"p{i + 1}") for i in (0, 1)])


@query("flatten_results", "SELECT l_returnflag, v FROM (SELECT l_returnflag, unnest([l_quantity, l_tax, l_discount]) AS v FROM lineitem)")
def flatten_results(spark, sf):
    nested = table(spark, sf, "lineitem").select("l_returnflag", F.array(F.array("l_quantity", "l_tax"), F.array("l_discount")).alias("v"))
    return C.flatten_results(nested, "v")


@query("best_trial", "SELECT l_linenumber AS trial, arg_max(l_returnflag || l_linestatus, s) AS params, round(max(s), 4) AS score FROM (SELECT l_linenumber, l_returnflag, l_linestatus, avg(l_extendedprice) AS s "
       "FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def best_trial(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("fun_id"), F.concat("l_returnflag", "l_linestatus").alias("trial")).agg(F.avg("l_extendedprice").alias("rel_err"))
    return CX.best_trials(s).select(F.col("fun_id").alias("trial"), F.col("trial").alias("params"), F.round("rel_err", 4).alias("score"))


@query("quality_threshold", f"WITH q AS (SELECT feature, avg(w) AS quality FROM ({RUNS}) GROUP BY 1), k AS (SELECT * FROM q WHERE quality >= 400) SELECT feature, round(quality, 6) AS quality FROM "
       "(SELECT * FROM k UNION ALL SELECT * FROM q WHERE feature = 'Brand#11' AND NOT EXISTS (SELECT 1 FROM k))")
def quality_threshold(spark, sf):
    """Methods that reach the cutoff, or the fallback where none does."""
    best = [r.asDict() for r in runs(spark, sf).groupBy("feature").agg(F.avg("w").alias("rel_err")).collect()]
    kept = CX.above_cutoff(best, 400, next(r for r in best if r["feature"] == "Brand#11"))
    return rounded(spark.createDataFrame([(r["feature"], r["rel_err"]) for r in kept], "feature string, quality double"))


# ---- metrics -----------------------------------------------------------------------------------

ERRS = "SELECT l_returnflag AS g, l_extendedprice AS y, 1400 * l_quantity + 500 AS p FROM lineitem"


def predicted(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), (1400 * F.col("l_quantity") + 500).alias("p"))


METRICS_SQL = (f"WITH e AS ({ERRS}), m AS (SELECT g, avg(y) AS my FROM e GROUP BY g) SELECT g, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS \"RMSE\", "
               "round(sqrt(avg((y - p) * (y - p))) / stddev_pop(y), 6) AS \"RMSE/std\", round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS \"MAPE\", round(avg(abs(y - p)), 4) AS \"MAE\", "
               "round(sum(abs(p - y)) / sum(abs(my - y)), 6) AS rae FROM e JOIN m USING (g) GROUP BY g")


@query("regression_metrics", METRICS_SQL)
def regression_metrics(spark, sf):
    m = M.regression_metrics(predicted(spark, sf), ["g"])
    return rounded(rounded(m, 4, ["RMSE", "MAE"]), 6, ["r2", "RMSE/std", "MAPE", "rae"])


@query("signed_scores", f"WITH e AS ({ERRS}) SELECT g, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(-avg(abs(y - p) / abs(y)), 6) AS \"MAPE\", round(-sqrt(avg((y - p) * (y - p))), 4) AS \"RMSE\", "
       "round(-avg(abs(y - p)), 4) AS \"MAE\" FROM e GROUP BY g")
def signed_scores(spark, sf):
    return predicted(spark, sf).groupBy("g").agg(*[F.round(M.score(s, "y", "p"), d).alias(s) for s, d in (("r2", 6), ("MAPE", 6), ("RMSE", 4), ("MAE", 4))])


CLASS = "SELECT l_linestatus AS g, CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_quantity > 25 AS INTEGER) AS p, l_quantity / 51 AS q FROM lineitem"


@query("classification_metrics", f"SELECT g, round(2.0 * sum(y * p) / (2 * sum(y * p) + sum(CAST(y <> p AS INTEGER))), 6) AS f1, round(avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)), 6) AS log_loss FROM ({CLASS}) GROUP BY g")
def classification_metrics(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("p"), (F.col("l_quantity") / 51).alias("q"))
    return c.groupBy("g").agg(F.round(M.f1("y", "p"), 6).alias("f1"), F.round(M.log_loss("y", "q"), 6).alias("log_loss"))


KINDS = ("SELECT l_linestatus AS g, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, CAST(floor(l_quantity / 20) AS INTEGER) AS p, "
         "(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN l_quantity ELSE 60 - l_quantity END) / 61 AS q FROM lineitem")


@query("classification_metrics_k", f"WITH c AS ({KINDS}), k AS (SELECT g, k, sum(CAST(y = k AND p = k AS INTEGER)) AS t, sum(CAST(y = k AS INTEGER)) AS a, sum(CAST(p = k AS INTEGER)) AS b FROM c, (VALUES (0), (1), (2)) v(k) GROUP BY g, k), "
       "f AS (SELECT g, round(avg(2.0 * t / (a + b)), 6) AS f1_macro, round(sum(2.0 * t / (a + b) * a) / sum(a), 6) AS f1_weighted, round(2.0 * sum(t) / sum(a + b), 6) AS f1_micro FROM k WHERE a + b > 0 GROUP BY g) "
       "SELECT f.*, l.log_loss FROM f JOIN (SELECT g, round(avg(-ln(q)), 6) AS log_loss FROM c GROUP BY g) l USING (g)")
def classification_metrics_k(spark, sf):
    """f1 and log loss over three classes."""
    flag, qty = F.col("l_returnflag"), F.col("l_quantity")
    c = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("g"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("y"), F.floor(qty / 20).cast("int").alias("p"),
                                            (F.when(flag == "A", 1).when(flag == "N", qty).otherwise(60 - qty) / 61).alias("q"))
    return c.groupBy("g").agg(*[F.round(M.f1_classes("y", "p", [0, 1, 2], a), 6).alias(f"f1_{a}") for a in ("macro", "weighted", "micro")], F.round(M.log_loss_given("q"), 6).alias("log_loss"))


SIDES = f"SELECT l_linenumber AS m, {sql_below('l_orderkey', 0.3)} AS is_test, l_extendedprice AS y, 0.9 * l_extendedprice + 100 * l_quantity AS p FROM lineitem"


@query("train_test_scores", f"WITH s AS (SELECT m, 1 - avg((y - p) * (y - p)) FILTER (NOT is_test) / var_pop(y) FILTER (NOT is_test) AS tr, 1 - avg((y - p) * (y - p)) FILTER (is_test) / var_pop(y) FILTER (is_test) AS te FROM ({SIDES}) GROUP BY m) "
       "SELECT m, round(tr, 6) AS train, round(te, 6) AS test, round(4 * abs(tr - te) + te, 6) AS weighted, round(abs(tr - te) + 4 * (1 - te), 6) AS weighted_class, round(tr * te / (tr + te), 2) * 2 AS harmonic FROM s WHERE te >= 0")
def train_test_scores(spark, sf):
    """Scores of both sides, their combinations, and the threshold on the test score."""
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("m"), is_test(["l_orderkey"]).alias("is_test"), F.col("l_extendedprice").alias("label"), (0.9 * F.col("l_extendedprice") + 100 * F.col("l_quantity")).alias("p"))
    numbers = sorted(r["m"] for r in rows.select("m").distinct().collect())
    models = [MD.FittedModel(str(m), {}, False, scores=MD.train_test_scores(rows.where(F.col("m") == m), M.r2)) for m in numbers]
    s = spark.createDataFrame([(int(x.name), *x.scores) for x in MD.select_models(models, 0.0)], "m int, tr double, te double")
    return s.select("m", F.round("tr", 6).alias("train"), F.round("te", 6).alias("test"), F.round(M.weighted_score("tr", "te"), 6).alias("weighted"),
                    F.round(M.weighted_score("tr", "te", True), 6).alias("weighted_class"), M.harmonic_score("tr", "te").alias("harmonic"))


DCOR = ("WITH e AS (SELECT event_id AS k, CAST(user_id AS DOUBLE) AS x, value AS y FROM events), r AS (SELECT a.k, avg(abs(a.x - b.x)) AS ma, avg(abs(a.y - b.y)) AS mb, avg(abs(a.x - b.x) * abs(a.y - b.y)) AS ab, "
        "avg((a.x - b.x) * (a.x - b.x)) AS aa, avg((a.y - b.y) * (a.y - b.y)) AS bb FROM e a, e b GROUP BY a.k), v AS (SELECT avg(ab) + avg(ma) * avg(mb) - 2 * avg(ma * mb) AS xy, "
        "avg(aa) + avg(ma) * avg(ma) - 2 * avg(ma * ma) AS xx, avg(bb) + avg(mb) * avg(mb) - 2 * avg(mb * mb) AS yy FROM r) SELECT 0 AS gid, round(sqrt(xy / sqrt(xx * yy)), 6) AS dcor FROM v")


@query("distance_correlation", DCOR)
def dcor(spark, sf):
    e = table(spark, sf, "events")
    return rounded(distance_correlation(e.select(F.lit(0).alias("gid"), F.col("event_id").alias("key"), F.col("user_id").alias("x"), F.col("value").alias("y"))))
