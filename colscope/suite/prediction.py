"""Registered queries on splits, baselines, neighbours, scans and refinement."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.keys import fold, is_test
from ..operators import predict as P, refine as RF
from ..operators.combine import get_column_combinations
from ..operators.gram import table_moments
from ..operators.neighbors import best_of, mean_of, nearest, vote_of
from ..operators.pairs import pair_sums
from ..plans import predictability as PP
from .common import query, rounded, sql_below, sql_fold, table, union_all

TST = sql_below("p_partkey", 0.3)
FOLD = sql_fold("p_partkey")


def part(spark, sf):
    return table(spark, sf, "part").withColumn("k", F.col("p_partkey"))


@query("split", f"SELECT o_orderkey, {sql_below('o_orderkey', 0.3)} AS is_test, {sql_fold('o_orderkey')} AS fold FROM orders")
def split(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", is_test(["o_orderkey"]).alias("is_test"), fold(["o_orderkey"]).alias("fold"))


# ---- baselines ---------------------------------------------------------------------------------

def _baseline(df, keys, ins, out):
    rows = P.split_rows(P.with_key(df, keys), ["__key"])
    rows = rows.select("__key", "is_test", "fold", *[F.col(c).cast("double").alias(c) for c in (*ins, out)])
    pairs = [(tuple(ins), (out,))]
    fits = P.fit_baselines(rows, [*ins, out], pairs)
    return rows, pairs, fits


@query("mean_baseline", f"WITH b AS (SELECT *, {sql_below('o_orderkey', 0.3)} AS t FROM orders), m AS (SELECT avg(o_totalprice) AS mean FROM b WHERE NOT t) "
       "SELECT round(mean, 4) AS mean, round(1 - avg((o_totalprice - mean) * (o_totalprice - mean)) / var_pop(o_totalprice), 8) AS r2, count(*) AS n_test FROM b, m WHERE t GROUP BY mean")
def mean_baseline(spark, sf):
    o = table(spark, sf, "orders")
    _, _, fits = _baseline(o, ["o_orderkey"], ["o_custkey"], "o_totalprice")
    mean = F.lit(fits[0].mean[0])
    test = o.where(is_test(["o_orderkey"]))
    sq = (F.col("o_totalprice") - mean) * (F.col("o_totalprice") - mean)
    return test.agg(F.round(mean, 4).alias("mean"), F.round(1 - F.avg(sq) / F.var_pop("o_totalprice"), 8).alias("r2"), F.count("*").alias("n_test"))


@query("linear_1", f"WITH b AS (SELECT *, {TST} AS t FROM part), m AS (SELECT regr_slope(p_retailprice, p_partkey) AS w, regr_intercept(p_retailprice, p_partkey) AS a FROM b WHERE NOT t) "
       "SELECT p_partkey, round(a + w * p_partkey, 6) AS prediction FROM b, m WHERE t")
def linear_1(spark, sf):
    rows, pairs, fits = _baseline(part(spark, sf), ["k"], ["p_partkey"], "p_retailprice")
    got = P.baseline_predictions(P.make_points(rows, ["p_partkey", "p_retailprice"], pairs), fits, 1)
    return got.where("is_test").select(F.col("key").alias("p_partkey"), F.round("linear0", 6).alias("prediction"))


@query("linear_2", f"WITH b AS (SELECT *, {TST} AS t FROM part), m AS (SELECT avg(p_partkey) m1, avg(p_size) m2, avg(p_retailprice) my, var_pop(p_partkey) s11, var_pop(p_size) s22, covar_pop(p_partkey, p_size) s12, "
       "covar_pop(p_partkey, p_retailprice) c1, covar_pop(p_size, p_retailprice) c2 FROM b WHERE NOT t), w AS (SELECT *, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) w1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) w2 FROM m) "
       "SELECT p_partkey, round(my + w1 * (p_partkey - m1) + w2 * (p_size - m2), 6) AS prediction FROM b, w WHERE t")
def linear_2(spark, sf):
    rows, pairs, fits = _baseline(part(spark, sf), ["k"], ["p_partkey", "p_size"], "p_retailprice")
    got = P.baseline_predictions(P.make_points(rows, ["p_partkey", "p_size", "p_retailprice"], pairs), fits, 1)
    return got.where("is_test").select(F.col("key").alias("p_partkey"), F.round("linear0", 6).alias("prediction"))


@query("power_law", f"WITH b AS (SELECT *, {TST} AS t FROM part), m AS (SELECT regr_slope(ln(p_retailprice), ln(p_size)) AS w, regr_intercept(ln(p_retailprice), ln(p_size)) AS a FROM b WHERE NOT t) "
       "SELECT p_partkey, round(exp(a + w * ln(p_size)), 6) AS prediction FROM b, m WHERE t")
def power_law(spark, sf):
    rows, pairs, fits = _baseline(part(spark, sf), ["k"], ["p_size"], "p_retailprice")
    got = P.baseline_predictions(P.make_points(rows, ["p_size", "p_retailprice"], pairs), fits, 1)
    return got.where("is_test").select(F.col("key").alias("p_partkey"), F.round("power0", 6).alias("prediction"))


@query("power_law_gate", "SELECT CAST(min(p_partkey) > 0 AND min(p_retailprice) > 0 AS BOOLEAN) AS fitted FROM part")
def power_law_gate(spark, sf):
    """No power law where a value is not positive: part keys begin at 0."""
    _, _, fits = _baseline(part(spark, sf), ["k"], ["p_partkey"], "p_retailprice")
    return table(spark, sf, "part").agg(F.lit(fits[0].power is not None).alias("fitted"))


@query("ridge_1", "WITH w AS (SELECT avg(l_quantity) mx, avg(l_extendedprice) my, covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) / (1 + 10000 / stddev_pop(l_extendedprice)) AS b FROM lineitem) "
       "SELECT l_quantity, count(*) AS n, round(avg(my + b * (l_quantity - mx)), 2) AS prediction FROM lineitem, w GROUP BY 1")
def ridge_1(spark, sf):
    """Ridge as in the refinement space: the penalty acts on the standardised input and target."""
    rows = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"), array_to_vector(F.array("l_quantity")).alias("features"))
    model = RF.ESTIMATORS["ridge"](regParam=10000.0, solver="normal").fit(rows)
    return model.transform(rows).groupBy("l_quantity").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 2).alias("prediction"))


# ---- neighbours --------------------------------------------------------------------------------

def knn_parts(spark, sf):
    rows = P.split_rows(part(spark, sf), ["p_partkey"])
    x = F.array(F.col("p_partkey").cast("double"), F.col("p_size").cast("double"))
    pts = rows.select(F.lit(0).alias("gid"), F.col("p_partkey").alias("key"), x.alias("x"), "is_test",
                      F.lit(0).alias("part"), F.array("p_retailprice").alias("y"))
    return pts.where("is_test"), pts.where(~F.col("is_test"))


def _knn_sql(dist: str, k: int, value: str) -> str:
    return (f"WITH b AS (SELECT *, {TST} AS t FROM part), n AS (SELECT q.p_partkey, b.p_retailprice AS y, {dist} AS d, row_number() OVER (PARTITION BY q.p_partkey ORDER BY {dist}, b.p_partkey) AS r "
            f"FROM b q, b WHERE q.t AND NOT b.t) SELECT p_partkey, round({value}, 6) AS prediction FROM n WHERE r <= {k} GROUP BY 1")


EUCLID = "sqrt((q.p_partkey - b.p_partkey) * (q.p_partkey - b.p_partkey) + (q.p_size - b.p_size) * (q.p_size - b.p_size))"


@query("knn_predict", _knn_sql(EUCLID, 8, "avg(y)"))
def knn_predict(spark, sf):
    q, b = knn_parts(spark, sf)
    nn = nearest(q, b, 8)
    return nn.select(F.col("key").alias("p_partkey"), F.round(mean_of(best_of("nn", 8)), 6).alias("prediction"))


@query("knn_weighted_l1", _knn_sql("(abs(q.p_partkey - b.p_partkey) + abs(q.p_size - b.p_size))", 5, "CASE WHEN min(d) = 0 THEN avg(y) FILTER (d = 0) ELSE sum(y / d) / sum(1 / d) END"))
def knn_weighted_l1(spark, sf):
    q, b = knn_parts(spark, sf)
    nn = nearest(q, b, 5, p=1)
    return nn.select(F.col("key").alias("p_partkey"), F.round(mean_of(best_of("nn", 5), 0, "distance"), 6).alias("prediction"))


@query("knn_classify", f"WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {sql_below('vec_id', 0.33)} AS t FROM embeddings), n AS (SELECT q.vec_id, b.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY "
       "list_distance(q.v, b.v), b.vec_id) AS r FROM e q, e b WHERE q.t AND NOT b.t), c AS (SELECT vec_id, label, count(*) AS n FROM n WHERE r <= 5 GROUP BY 1, 2) "
       "SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS r FROM c) WHERE r = 1")
def knn_classify(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit(0).alias("gid"), F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("x"),
                                              is_test(["vec_id"], 0.33).alias("t"), F.lit(0).alias("part"), F.array(F.col("label").cast("double")).alias("y"))
    nn = nearest(e.where("t"), e.where("NOT t"), 5)
    return nn.select(F.col("key").alias("vec_id"), vote_of(best_of("nn", 5)).alias("prediction"))


@query("pair_distance", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, round(sum(list_distance(a.v, b.v)), 5) AS total, "
       "round(max(list_distance(a.v, b.v) * 0 + 0) , 5) AS zero FROM e a, e b GROUP BY 1")
def pair_distance(spark, sf):
    """Sum of the distances of each row to all rows."""
    from ..operators.neighbors import block_distances

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("x"))
    got = pair_sums(e, lambda a, b: {"total": block_distances(a["x"], b["x"]).sum(axis=1)}, ["total"], e.count())
    return got.select(F.col("key").alias("vec_id"), F.round("total", 5).alias("total"), F.lit(0.0).alias("zero"))


# ---- scans -------------------------------------------------------------------------------------

def scan_base_sql(tuples: list[list[str]], target: str = "p_retailprice") -> str:
    d = max(map(len, tuples))
    xs = lambda t: ", ".join(f"CAST({t[j]} AS DOUBLE) AS x{j}" if j < len(t) else f"0.0 AS x{j}" for j in range(d))
    return union_all([f"SELECT {i} AS tid, p_partkey AS key, {TST} AS t, {FOLD} AS fold, CAST({target} AS DOUBLE) AS y, {xs(t)} FROM part" for i, t in enumerate(tuples)])


def scan_ctes(tuples: list[list[str]]) -> str:
    """Grid search and final neighbours of the given input tuples, as SQL over all pairs."""
    d = max(map(len, tuples))
    dist = "sqrt(" + " + ".join(f"(q.x{j} - b.x{j}) * (q.x{j} - b.x{j})" for j in range(d)) + ")"
    ks = P.K_LIST
    preds = ", ".join(f"avg(ny) FILTER (r <= {k}) AS p{k}" for k in ks)
    return (f"base AS ({scan_base_sql(tuples)}), nn AS MATERIALIZED (SELECT q.tid, q.key, q.t, q.fold, q.y, b.key AS bkey, b.fold AS bfold, b.y AS ny, {dist} AS d FROM base q JOIN base b ON q.tid = b.tid WHERE NOT b.t), "
            f"cvp AS (SELECT tid, f, key, any_value(fold) AS fold, any_value(y) AS y, {preds} FROM (SELECT *, row_number() OVER (PARTITION BY tid, f, key ORDER BY d, bkey) AS r FROM nn, (VALUES (0), (1), (2)) v(f) "
            "WHERE NOT t AND bfold <> f) GROUP BY 1, 2, 3), "
            + "cv AS (" + union_all([f"SELECT tid, {k} AS k, f, 1 - avg((y - p{k}) * (y - p{k})) FILTER (fold = f) / var_pop(y) FILTER (fold = f) AS test_score, "
                                    f"1 - avg((y - p{k}) * (y - p{k})) FILTER (fold <> f) / var_pop(y) FILTER (fold <> f) AS train_score FROM cvp GROUP BY 1, 3" for k in ks]) + "), "
            "best AS (SELECT tid, k FROM (SELECT tid, k, row_number() OVER (PARTITION BY tid ORDER BY avg(test_score) DESC, k) AS r FROM cv GROUP BY 1, 2) WHERE r = 1), "
            f"fin AS (SELECT tid, key, any_value(y) AS y, {preds} FROM (SELECT *, row_number() OVER (PARTITION BY tid, key ORDER BY d, bkey) AS r FROM nn WHERE t) GROUP BY 1, 2), "
            "knn AS (SELECT f.tid, f.key, f.y, CASE b.k WHEN 3 THEN p3 WHEN 8 THEN p8 ELSE p15 END AS p FROM fin f JOIN best b USING (tid))")


def metrics_sql(preds: str) -> str:
    """Long metric table of a relation ``tid, method, key, y, p``."""
    return (f"pr AS ({preds}), my AS (SELECT tid, method, avg(y) AS my FROM pr GROUP BY 1, 2), ms AS (SELECT tid, method, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse, "
            "sqrt(avg((y - p) * (y - p))) / stddev_pop(y) AS rs, avg(abs(y - p) / abs(y)) AS mape, sum(abs(y - p)) / sum(abs(y - my)) AS rae FROM pr JOIN my USING (tid, method) GROUP BY 1, 2), "
            "pw AS (SELECT a.tid, a.method, a.key, avg(abs(a.y - b.y)) AS ma, avg(abs(a.p - b.p)) AS mb, avg(abs(a.y - b.y) * abs(a.p - b.p)) AS ab, avg((a.y - b.y) * (a.y - b.y)) AS aa, avg((a.p - b.p) * (a.p - b.p)) AS bb "
            "FROM pr a JOIN pr b ON a.tid = b.tid AND a.method = b.method GROUP BY 1, 2, 3), dv AS (SELECT tid, method, avg(ab) + avg(ma) * avg(mb) - 2 * avg(ma * mb) AS xy, avg(aa) + avg(ma) * avg(ma) - 2 * avg(ma * ma) AS xx, "
            "avg(bb) + avg(mb) * avg(mb) - 2 * avg(mb * mb) AS yy FROM pw GROUP BY 1, 2), dc AS (SELECT tid, method, CASE WHEN method = 'mean' OR yy <= 0 THEN 0 ELSE sqrt(greatest(xy, 0) / sqrt(xx * yy)) END AS dcor FROM dv), "
            "lng AS (SELECT tid, method, unnest(['r2', 'RMSE', 'RMSE/std', 'MAPE', 'rae', 'dcor']) AS metric, unnest([r2, rmse, rs, mape, rae, dcor]) AS value FROM ms JOIN dc USING (tid, method))")


def linear_1_sql(tid: int, col: str, log: bool) -> str:
    x, y = (f"ln({col})", "ln(p_retailprice)") if log else (col, "p_retailprice")
    value = f"a + w * {x}"
    value = f"exp({value})" if log else value
    return (f"SELECT {tid} AS tid, '{'pow. law' if log else 'linear'}' AS method, p_partkey AS key, CAST(p_retailprice AS DOUBLE) AS y, {value} AS p FROM part, "
            f"(SELECT regr_slope({y}, {x}) AS w, regr_intercept({y}, {x}) AS a FROM part WHERE NOT {TST}) WHERE {TST}")


MEAN_SQL = f"SELECT tid, 'mean' AS method, p_partkey AS key, CAST(p_retailprice AS DOUBLE) AS y, m AS p FROM part, (SELECT avg(p_retailprice) AS m FROM part WHERE NOT {TST}), (VALUES (0), (1)) v(tid) WHERE {TST}"
SCAN_TUPLES = [["p_partkey"], ["p_size"]]
SCAN_PREDS = union_all(["SELECT tid, 'kNN' AS method, key, y, p FROM knn", MEAN_SQL, linear_1_sql(0, "p_partkey", False), linear_1_sql(1, "p_size", False), linear_1_sql(1, "p_size", True)])
SCAN_WITH = f"WITH {scan_ctes(SCAN_TUPLES)}, {metrics_sql(SCAN_PREDS)}"
# tuple 0 has no power law: its metrics are there, without values
NO_LAW = "SELECT 0 AS tuple_id, 'pow. law' AS method, unnest(['r2', 'RMSE', 'RMSE/std', 'MAPE', 'rae']) AS metric, CAST(NULL AS DOUBLE) AS value"


def part_scan(spark, sf, **options):
    cols = ["p_partkey", "p_size", "p_retailprice"]
    return PP.scan_tuples(part(spark, sf), get_column_combinations(cols, 1, 1, ["p_retailprice"]), keys=["k"], **options)


@query("predict_scan", f"{SCAN_WITH} SELECT tid AS tuple_id, method, metric, round(value, 5) AS value FROM lng UNION ALL {NO_LAW}")
def predict_scan(spark, sf):
    return rounded(part_scan(spark, sf).metrics, 5)


@query("knn_cv", f"WITH {scan_ctes(SCAN_TUPLES)} SELECT tid AS tuple_id, CAST(k AS VARCHAR) AS n_neighbors, scaler, f AS fold, round(test_score, 6) AS test_score, round(train_score, 6) AS train_score FROM cv, (VALUES ('false'), ('true')) s(scaler)")
def knn_cv(spark, sf):
    """Cross-validation table of the grid, for each fold."""
    cv = part_scan(spark, sf, with_dcor=False).cv
    return rounded(cv.select("tuple_id", F.col("params")["n_neighbors"].alias("n_neighbors"), F.col("params")["scaler"].alias("scaler"), "fold", "test_score", "train_score"))


@query("grid_best", f"WITH {scan_ctes(SCAN_TUPLES)} SELECT tid AS tuple_id, CAST(k AS VARCHAR) AS n_neighbors, round((SELECT avg(test_score) FROM cv c WHERE c.tid = b.tid AND c.k = b.k), 6) AS score FROM best b")
def grid_best(spark, sf):
    cv = part_scan(spark, sf, scaling="no", with_dcor=False).cv
    mean = cv.groupBy("tuple_id", F.col("params")["n_neighbors"].alias("n_neighbors")).agg(F.avg("test_score").alias("score"))
    best = F.max_by(F.struct("n_neighbors", "score"), F.struct("score", -F.col("n_neighbors").cast("int"))).alias("b")
    return rounded(mean.groupBy("tuple_id").agg(best).select("tuple_id", "b.n_neighbors", "b.score"))


@query("best_per_target", f"{SCAN_WITH} SELECT 'p_retailprice' AS outputs, CASE tid WHEN 0 THEN 'p_partkey' ELSE 'p_size' END AS inputs, round(value, 5) AS value FROM lng WHERE method = 'kNN' AND metric = 'r2' ORDER BY value DESC LIMIT 1")
def best_per_target(spark, sf):
    run = part_scan(spark, sf, with_dcor=False)
    return rounded(PP.best_per_target(run.metrics, run.tuples).select(F.concat_ws("+", "outputs").alias("outputs"), F.concat_ws("+", "inputs").alias("inputs"), "value"), 5)


@query("top_tuples", f"{SCAN_WITH} SELECT tid AS tuple_id, round(value, 5) AS r2 FROM lng WHERE method = 'kNN' AND metric = 'r2' ORDER BY value DESC LIMIT 1")
def top_tuples(spark, sf):
    return rounded(PP.tuple_selection(part_scan(spark, sf, with_dcor=False).metrics), 5)


@query("wide_metrics", f"{SCAN_WITH} SELECT CASE tid WHEN 0 THEN 'p_partkey' ELSE 'p_size' END AS inputs, round(max(value) FILTER (method = 'kNN' AND metric = 'r2'), 5) AS knn_r2, "
       "round(max(value) FILTER (method = 'linear' AND metric = 'RMSE'), 4) AS linear_rmse, round(max(value) FILTER (method = 'pow. law' AND metric = 'MAPE'), 6) AS power_mape FROM lng GROUP BY tid")
def wide_metrics(spark, sf):
    w = part_scan(spark, sf, with_dcor=False).wide()
    return w.select(F.concat_ws("+", "inputs").alias("inputs"), F.round("kNN r2", 5).alias("knn_r2"), F.round("linear RMSE", 4).alias("linear_rmse"), F.round(F.col("`pow. law MAPE`"), 6).alias("power_mape"))


@query("sorted_metrics", f"{SCAN_WITH} SELECT tid AS tuple_id, method, round(value, 5) AS r2 FROM lng WHERE metric = 'r2'")
def sorted_metrics(spark, sf):
    m = part_scan(spark, sf, with_dcor=False).metrics.where("metric = 'r2' AND value IS NOT NULL")
    return m.orderBy(F.desc("value"), "tuple_id").select("tuple_id", "method", F.round("value", 5).alias("r2"))


@query("residuals", f"{SCAN_WITH} SELECT tid AS tuple_id, CASE method WHEN 'kNN' THEN 'main' WHEN 'linear' THEN 'linear' ELSE 'power' END AS method, key, round(y, 6) AS true, round(p, 6) AS pred, round(p - y, 6) AS error FROM pr WHERE method <> 'mean'")
def residuals(spark, sf):
    rows = P.residuals(part_scan(spark, sf, with_dcor=False).predictions)
    return rounded(rows.drop("output"))


@query("error_histogram", f"{SCAN_WITH}, e AS (SELECT tid, round(p - y, 6) AS error FROM pr WHERE method = 'linear'), x AS (SELECT tid, min(error) lo, max(error) hi, greatest(floor(count(*) * 0.1), 1) AS bins FROM e GROUP BY 1) "
       "SELECT tid AS tuple_id, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((error - lo) * bins / (hi - lo)) + 1, bins) END AS INTEGER) AS bin, count(*) AS n FROM e JOIN x USING (tid) GROUP BY 1, 2")
def error_histogram(spark, sf):
    rows = P.residuals(part_scan(spark, sf, with_dcor=False).predictions, columns=("linear",)).withColumn("error", F.round("error", 6))
    return P.error_histogram(rows, ["tuple_id"])


GREEDY = [["p_partkey"], ["p_size"], ["p_partkey", "p_size"]]


@query("greedy_2", f"WITH {scan_ctes(GREEDY)} SELECT tid AS tuple_id, CASE tid WHEN 0 THEN 'p_partkey' WHEN 1 THEN 'p_size' ELSE 'p_partkey+p_size' END AS inputs, round(1 - avg((y - p) * (y - p)) / var_pop(y), 5) AS r2, "
       "round(sqrt(avg((y - p) * (y - p))), 5) AS rmse FROM knn GROUP BY 1")
def greedy_2(spark, sf):
    """Two rounds: the best single input, then its best partner."""
    run = PP.greedy_scan(part(spark, sf), ["p_partkey", "p_size"], 2, [("p_retailprice",)], keys=["k"], scaling="no", with_dcor=False)
    knn = run.metrics.where("method = 'kNN'").groupBy("tuple_id").agg(
        F.max(F.when(F.col("metric") == "r2", F.col("value"))).alias("r2"), F.max(F.when(F.col("metric") == "RMSE", F.col("value"))).alias("rmse"))
    return rounded(knn.join(run.tuples, "tuple_id").select("tuple_id", F.concat_ws("+", F.array_sort("inputs")).alias("inputs"), "r2", "rmse"), 5)


@query("multi_output_linear", f"WITH b AS (SELECT *, {TST} AS t FROM part), m AS (SELECT regr_slope(p_retailprice, p_partkey) w1, regr_intercept(p_retailprice, p_partkey) a1, regr_slope(p_size, p_partkey) w2, regr_intercept(p_size, p_partkey) a2 "
       "FROM b WHERE NOT t), e AS (SELECT p_retailprice y1, a1 + w1 * p_partkey p1, CAST(p_size AS DOUBLE) y2, a2 + w2 * p_partkey p2 FROM b, m WHERE t), c AS (SELECT (avg(y1) + avg(y2)) / 2 AS c FROM e) "
       "SELECT round((1 - avg((y1 - p1) * (y1 - p1)) / var_pop(y1) + 1 - avg((y2 - p2) * (y2 - p2)) / var_pop(y2)) / 2, 6) AS r2, round((sqrt(avg((y1 - p1) * (y1 - p1))) + sqrt(avg((y2 - p2) * (y2 - p2)))) / 2, 5) AS rmse, "
       "round((sum(abs(y1 - p1)) + sum(abs(y2 - p2))) / (sum(abs(y1 - c)) + sum(abs(y2 - c))), 6) AS rae FROM e, c")
def multi_output_linear(spark, sf):
    """Two targets at once: means over the outputs, and the error sums of both together."""
    run = PP.scan_tuples(part(spark, sf), [(("p_partkey",), ("p_retailprice", "p_size"))], keys=["k"], with_dcor=False)
    m = run.metrics.where("method = 'linear'")
    pick = lambda n: F.max(F.when(F.col("metric") == n, F.col("value")))
    return m.agg(F.round(pick("r2"), 6).alias("r2"), F.round(pick("RMSE"), 5).alias("rmse"), F.round(pick("rae"), 6).alias("rae"))


@query("scan_with_gaps", "WITH h AS (SELECT *, nullif(p_size, 7) AS s FROM part) SELECT 0 AS tuple_id, count(*) FILTER (NOT t) AS n_train, count(*) FILTER (t) AS n_test, round(avg(p_retailprice) FILTER (NOT t), 6) AS mean FROM "
       f"(SELECT *, {TST} AS t FROM h) WHERE s IS NOT NULL UNION ALL SELECT 1, count(*) FILTER (NOT t), count(*) FILTER (t), round(avg(p_retailprice) FILTER (NOT t), 6) FROM (SELECT *, {TST} AS t FROM h)")
def scan_with_gaps(spark, sf):
    """Each tuple keeps the rows complete in its own columns, all from the same sums."""
    df = part(spark, sf).withColumn("s", F.nullif("p_size", F.lit(7)))
    rows = P.split_rows(P.with_key(df, ["k"]), ["__key"]).select("__key", "is_test", "fold", *[F.col(c).cast("double").alias(c) for c in ("s", "p_partkey", "p_retailprice")])
    fits = P.fit_baselines(rows, ["s", "p_partkey", "p_retailprice"], [(("s",), ("p_retailprice",)), (("p_partkey",), ("p_retailprice",))])
    return P.baseline_frame(spark, fits).select("tuple_id", "n_train", "n_test", F.round(F.col("mean")[0], 6).alias("mean"))


@query("scan_repeated_key", "SELECT 0 AS tuple_id, count(*) AS predicted, round(sum(p_retailprice), 2) AS y_sum FROM part")
def scan_repeated_key(spark, sf):
    """A key column whose values repeat names no row: every complete row still gets its prediction."""
    run = PP.scan_tuples(table(spark, sf, "part"), [(("p_partkey",), ("p_retailprice",))], keys=["p_size"], with_dcor=False)
    return run.predictions.groupBy("tuple_id").agg(F.count("main0").alias("predicted"), F.round(F.sum("y0"), 2).alias("y_sum"))


@query("covariance", "WITH l AS (SELECT * FROM lineitem) " + union_all(
    [f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov FROM l" for a in ("l_quantity", "l_discount", "l_tax") for b in ("l_quantity", "l_discount", "l_tax")]))
def covariance(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    cov = table_moments(table(spark, sf, "lineitem"), cols).cov
    return rounded(spark.createDataFrame([(a, b, float(cov[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)], "a string, b string, cov double"), 4)


# ---- refinement --------------------------------------------------------------------------------

def _prepared(spark, sf, name):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("x"))
    rows = o.withColumn("features", array_to_vector("x"))
    return RF.fit_preparation(name, rows)(rows)


@query("scale_minmax", "SELECT o_orderkey AS key, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS a, "
       "round((o_custkey - min(o_custkey) OVER ()) / CAST(max(o_custkey) OVER () - min(o_custkey) OVER () AS DOUBLE), 6) AS b FROM orders")
def scale_minmax(spark, sf):
    return _prepared(spark, sf, "minmax").select("key", F.round(F.col("x")[0], 6).alias("a"), F.round(F.col("x")[1], 6).alias("b"))


@query("scale_maxabs", "SELECT o_orderkey AS key, round(o_totalprice / max(abs(o_totalprice)) OVER (), 6) AS a, round(o_custkey / CAST(max(abs(o_custkey)) OVER () AS DOUBLE), 6) AS b FROM orders")
def scale_maxabs(spark, sf):
    return _prepared(spark, sf, "maxabs").select("key", F.round(F.col("x")[0], 6).alias("a"), F.round(F.col("x")[1], 6).alias("b"))


@query("scale_standard", "SELECT o_orderkey AS key, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS a, round((o_custkey - avg(o_custkey) OVER ()) / stddev_samp(o_custkey) OVER (), 6) AS b FROM orders")
def scale_standard(spark, sf):
    return _prepared(spark, sf, "standard").select("key", F.round(F.col("x")[0], 6).alias("a"), F.round(F.col("x")[1], 6).alias("b"))


@query("scale_robust", "WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS a, quantile_cont(o_custkey::DOUBLE, [0.25, 0.5, 0.75]) AS b FROM orders) "
       "SELECT o_orderkey AS key, round((o_totalprice - q.a[2]) / (q.a[3] - q.a[1]), 6) AS a, round((o_custkey - q.b[2]) / (q.b[3] - q.b[1]), 6) AS b FROM orders, q")
def scale_robust(spark, sf):
    return _prepared(spark, sf, "robust").select("key", F.round(F.col("x")[0], 6).alias("a"), F.round(F.col("x")[1], 6).alias("b"))


@query("polynomial_2", "SELECT o_orderkey AS key, round(o_totalprice, 2) AS a, round(o_totalprice * o_totalprice, 1) AS aa, CAST(o_custkey AS DOUBLE) AS b, round(o_totalprice * o_custkey, 2) AS ab, CAST(o_custkey * o_custkey AS DOUBLE) AS bb FROM orders")
def polynomial_2(spark, sf):
    x = lambda i, d: F.round(F.col("x")[i], d)
    return _prepared(spark, sf, "poly2").select("key", x(0, 2).alias("a"), x(1, 1).alias("aa"), x(2, 0).alias("b"), x(3, 2).alias("ab"), x(4, 0).alias("bb"))


@query("kernel_features")
def kernel_features(spark, sf):
    return _prepared(spark, sf, "nystroem").select("key", F.posexplode("x").alias("component", "value"))


def _refined(spark, sf, name, trials=1, preparations=("none",), space=None):
    space = space or {name: RF.SPACE[name]}
    got = RF.refine_tuples(part(spark, sf), [(0, ("p_partkey", "p_size"), ("p_retailprice",))], ["k"], n_trials=trials, space=space, preparations=list(preparations))
    return got.metrics


def _register_regressors():
    for name in RF.SPACE:
        if name == "sgd":  # with the regressor's defaults
            query("refine_sgd")(lambda spark, sf: _refined(spark, sf, "sgd", space={"sgd": lambda r: {}}))
            continue
        trials = 4 if name in ("boosting", "xgb", "ada_boost") else 1  # settings of these are fitted side by side
        query(f"refine_{name}")(lambda spark, sf, name=name, trials=trials: _refined(spark, sf, name, trials))


_register_regressors()


@query("refine")
def refine(spark, sf):
    """A search across preparations and regressors for the best tuple of a scan."""
    space = {n: RF.SPACE[n] for n in ("ridge", "decision_tree", "knn")}
    return _refined(spark, sf, "", 3, ("none", "standard"), space)


@query("compare_refined")
def compare_refined(spark, sf):
    """First metrics beside the refined ones, by tuple."""
    run = part_scan(spark, sf, with_dcor=False)
    run.refined = PP.refine_predictability(part(spark, sf), run, 1, ["k"], n_trials=1, space={"decision_tree": RF.SPACE["decision_tree"]}, preparations=["none"])
    return PP.compare_refined(run.metrics, run.refined.metrics)


@query("mlp_scan")
def mlp_scan(spark, sf):
    run = part_scan(spark, sf, method="MLP", hidden_layers=[(12,), (20, 5)], alphas=[1e-3, 1e-5], rounds=4)
    return run.metrics
