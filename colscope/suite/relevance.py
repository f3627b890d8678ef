"""Registered queries on models, stacking, attributions and knockoffs."""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.keys import is_test
from ..operators import boosting as BO, clean as C, knockoff as KO, matrix as MX, mlp, models as MD, shapley as SH
from ..operators.predict import split_rows
from ..operators.quantiles import exact_quantiles
from ..operators.tree_shapley import tree_shapley
from ..plans.relevance import check_options, prepare, relevance
from .common import query, rounded, sql_below, table

INPUTS = ["o_totalprice", "o_custkey", "o_day"]
TARGET = "CAST(o_totalprice * 2 + o_custkey * 100 AS DOUBLE)"


def planted(spark, sf):
    """orders with a target that depends on two of three inputs."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"),
                    F.dayofyear("o_orderdate").cast("double").alias("o_day"),
                    (F.col("o_totalprice") * 2 + F.col("o_custkey") * 100).alias("y"))


@query("split_scaled", f"WITH b AS (SELECT *, {sql_below('o_orderkey', 0.33)} AS is_test FROM orders), s AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) d FROM b WHERE NOT is_test) "
       "SELECT o_orderkey, is_test, round((o_totalprice - m) / d, 6) AS o_totalprice FROM b, s")
def split_scaled(spark, sf):
    """Split first, then scale both sides by the training rows."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", is_test(["o_orderkey"], 0.33).alias("is_test"))
    train, test = C.scale_split(rows.where("NOT is_test"), rows.where("is_test"), ["o_totalprice"])
    return rounded(train.unionByName(test).select("o_orderkey", "is_test", "o_totalprice"))


def _rows(spark, sf, options=None):
    o = check_options({"keys": ["o_orderkey"], **(options or {})})
    return MD.feature_rows(prepare(planted(spark, sf), INPUTS, "y", o), INPUTS, "__y")


SMALL = MD.Limits(n_trials=1, boosted_round=5, max_depth=5, rf_n_estimators=50, bagging_estimators=12, n_neighbors=10)

# boosted models: rounds, depths and bins of the operators where trees stay small, fewer rounds for the deep ones
SEARCH = {"briskxgboost": MD.Limits(n_trials=4), "sluglgbm": MD.Limits(n_trials=4), "slugxgboost": MD.Limits(n_trials=2, boosted_round=10)}


def _scores(spark, fitted):
    return spark.createDataFrame([(m.name, *map(float, m.scores)) for m in fitted], "model string, train double, test double")


def _register_models():
    for name in MD.MODEL_NAMES:
        def run(spark, sf, name=name):
            return _scores(spark, [MD.fit_base(_rows(spark, sf), name, SEARCH.get(name, SMALL))])
        query(f"model_{name}")(run)


_register_models()


@query("model_search")
def model_search(spark, sf):
    """Several sampled settings, compared on hash folds."""
    return _scores(spark, [MD.fit_base(_rows(spark, sf), "briskbagging", MD.Limits(**{**SMALL.__dict__, "n_trials": 2}))])


@query("model_classification")
def model_classification(spark, sf):
    rows = _rows(spark, sf)
    cut = rows.agg(F.avg("label")).first()[0]
    return _scores(spark, [MD.fit_base(rows.withColumn("label", (F.col("label") > cut).cast("double")), "briskbagging", SMALL, classification=True)])


@query("model_classes")
def model_classes(spark, sf):
    """Softmax boosting and neighbours on three classes, searched by log loss."""
    rows = _rows(spark, sf)
    low, high = rows.agg(F.expr("percentile(label, array(0.33, 0.67))")).first()[0]
    rows = rows.withColumn("label", (F.col("label") > low).cast("double") + (F.col("label") > high).cast("double"))
    return _scores(spark, [MD.fit_base(rows, n, MD.Limits(n_trials=3, boosted_round=20, n_neighbors=10), classification=True) for n in ("briskxgboost", "briskknn")])


@query("stack")
def stack(spark, sf):
    """Bagged trees over out-of-fold predictions of two base models."""
    rows = _rows(spark, sf)
    base = [MD.fit_base(rows, n, SMALL) for n in ("briskbagging", "slugrf")]
    return spark.createDataFrame([("stack", *map(float, MD.fit_stack(rows, base, SMALL).scores))], "model string, train double, test double")


# ---- attributions ------------------------------------------------------------------------------

# slopes of y on price and size, and the mean absolute share of each in the prediction
LIN = ("WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS DOUBLE) AS a, CAST(p_size AS DOUBLE) AS b, p_retailprice AS y FROM part), m AS (SELECT avg(a) ma, avg(b) mb, median(a) da, median(b) db, var_pop(a) s11, var_pop(b) s22, "
       "covar_pop(a, b) s12, covar_pop(a, y) c1, covar_pop(b, y) c2 FROM p), w AS (SELECT *, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) w1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) w2 FROM m) ")


def linear_part(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.array(F.col("p_partkey").cast("double"), F.col("p_size").cast("double")).alias("x"),
                                           F.col("p_retailprice").alias("label"))
    from pyspark.ml.functions import array_to_vector
    rows = rows.withColumn("features", array_to_vector("x"))
    model = LinearRegression(solver="normal").fit(rows)
    return rows, model, lambda r: model.transform(r).withColumnRenamed("prediction", "p")


@query("shapley_linear", LIN + "SELECT 'p_partkey' AS feature, round(avg(abs(w1 * (a - ma))), 6) AS score FROM p, w UNION ALL SELECT 'p_size', round(avg(abs(w2 * (b - mb))), 6) FROM p, w")
def shapley_linear(spark, sf):
    """Exact Shapley values; for a linear model they are weight times distance from the mean."""
    rows, _, predict = linear_part(spark, sf)
    means = list(rows.agg(F.avg(F.col("x")[0]), F.avg(F.col("x")[1])).first())
    return rounded(SH.attribution_table(SH.shapley_values(rows, predict, 2, means), ["p_partkey", "p_size"]))


@query("shapley_rows", LIN + "SELECT k AS key, round(w1 * (a - da), 6) AS phi0, round(w2 * (b - db), 6) AS phi1 FROM p, w")
def shapley_rows(spark, sf):
    """Shapley values per row against the column medians."""
    rows, _, predict = linear_part(spark, sf)
    med = exact_quantiles(rows.select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), ["a", "b"], [0.5])
    phi = SH.shapley_values(rows, predict, 2, [med["a"][0], med["b"][0]])
    return phi.select("key", F.round(F.col("phi")[0], 6).alias("phi0"), F.round(F.col("phi")[1], 6).alias("phi1"))


@query("integrated_gradients_linear", LIN + "SELECT 'p_partkey' AS feature, round(avg(abs(w1 * a)), 6) AS score FROM p, w UNION ALL SELECT 'p_size', round(avg(abs(w2 * b)), 6) FROM p, w")
def integrated_gradients_linear(spark, sf):
    """From zero along the straight path; for a linear model that is weight times value."""
    rows, model, _ = linear_part(spark, sf)
    w = np.array(model.coefficients.toArray())
    phi = SH.integrated_gradients(rows, lambda x: np.repeat(w[None], len(x), axis=0))
    return rounded(SH.attribution_table(phi, ["p_partkey", "p_size"]))


@query("shapley_background")
def shapley_background(spark, sf):
    rows, _, predict = linear_part(spark, sf)
    return SH.attribution_table(SH.background_shapley(rows, predict, 2), ["p_partkey", "p_size"])


@query("shapley_trees")
def shapley_trees(spark, sf):
    """Mean absolute Shapley values of a forest, from the paths to its leaves."""
    rows = _rows(spark, sf)
    model = MD.fit_base(rows, "slugrf", MD.Limits(**{**SMALL.__dict__, "rf_n_estimators": 50}))
    return SH.attribution_table(tree_shapley(rows, model.model)[0], INPUTS)


# the best single split of part by size, for second-order boosting with l2 = 1, and its two leaves
STUMP = ("WITH p AS (SELECT p_partkey, p_size AS x, p_retailprice + 10 * p_size AS y FROM part), m AS (SELECT avg(y) AS b FROM p), c AS (SELECT DISTINCT x AS t FROM p), "
         "s AS (SELECT t, sum(CASE WHEN x <= t THEN b - y ELSE 0 END) AS gl, sum(CASE WHEN x <= t THEN 1 ELSE 0 END) AS nl, sum(b - y) AS g, count(*) AS n, min(b) AS b FROM c, p, m GROUP BY t), "
         "t AS (SELECT t, b, nl, n, -gl / (nl + 1) AS lv, -(g - gl) / (n - nl + 1) AS rv FROM s WHERE nl < n ORDER BY gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) DESC, t LIMIT 1) ")


def _stump(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.lit(0).alias("fold"), F.array(F.lit(1.0), F.col("p_size").cast("double")).alias("x"), (F.col("p_retailprice") + 10 * F.col("p_size")).alias("label"))
    return rows, BO.fit_many(rows, [(BO.Boosting(rounds=1, rate=1.0, max_depth=1, l2=1.0), None)])[0]


@query("boosting_stump", STUMP + "SELECT CAST(t AS DOUBLE) AS threshold, round(b, 6) AS start, round(lv, 6) AS left_value, round(rv, 6) AS right_value, CAST(nl AS DOUBLE) AS left_rows FROM t")
def boosting_stump(spark, sf):
    """One round of one split: the best of all thresholds, penalised leaf values."""
    _, m = _stump(spark, sf)
    t = m.trees[0][0]
    return rounded(spark.createDataFrame([(float(t.threshold[0]), float(m.start[0]), float(t.value[t.left[0]]), float(t.value[t.right[0]]), float(t.cover[t.left[0]]))],
                                         "threshold double, start double, left_value double, right_value double, left_rows double"))


@query("shapley_stump", STUMP + "SELECT p_partkey AS key, 0.0::DOUBLE AS phi0, round(CASE WHEN x <= t THEN lv ELSE rv END - (nl * lv + (n - nl) * rv) / n, 6) AS phi1 FROM p, t")
def shapley_stump(spark, sf):
    """Tree Shapley values of one split: the leaf's value minus the mean, all of it the split column's."""
    rows, m = _stump(spark, sf)
    phi, _ = tree_shapley(rows, m)
    return phi.select("key", F.round(F.col("phi")[0], 6).alias("phi0"), F.round(F.col("phi")[1], 6).alias("phi1"))


ADA = ("WITH p AS (SELECT p_size AS x, p_retailprice + 10 * p_size AS y FROM part), c AS (SELECT DISTINCT x AS t FROM p), "
       "s AS (SELECT t, sum(CASE WHEN x <= t THEN y ELSE 0 END) AS yl, sum(CASE WHEN x <= t THEN 1 ELSE 0 END) AS nl, sum(y) AS yy, count(*) AS n FROM c, p GROUP BY t), "
       "t AS (SELECT t, yl / nl AS lv, (yy - yl) / (n - nl) AS rv FROM s WHERE nl < n ORDER BY yl * yl / nl + (yy - yl) * (yy - yl) / (n - nl) DESC, t LIMIT 1), e AS (SELECT abs(y - CASE WHEN x <= t THEN lv ELSE rv END) AS e, t, lv, rv FROM p, t), "
       "l AS (SELECT avg(e) / max(e) AS l, min(t) AS t, min(lv) AS lv, min(rv) AS rv FROM e) ")


@query("adaboost_round", ADA + "SELECT CAST(t AS DOUBLE) AS threshold, round(lv, 6) AS left_value, round(rv, 6) AS right_value, round(ln((1 - l) / l), 6) AS weight FROM l")
def adaboost_round(spark, sf):
    """First round of AdaBoost.R2 with stumps and linear loss: split, leaves, and the tree's weight."""
    rows, _ = _stump(spark, sf)
    m = BO.fit_adaboost(rows, [(BO.Reweighting(1, 1.0, "linear", max_depth=1), None)])[0]
    t = m.trees[0]
    return rounded(spark.createDataFrame([(float(t.threshold[0]), float(t.value[t.left[0]]), float(t.value[t.right[0]]), float(m.weights[0]))], "threshold double, left_value double, right_value double, weight double"))


@query("boosting_quantile", "WITH g AS (SELECT CAST(p_size > 25 AS DOUBLE) AS x, p_retailprice + 100 * p_size AS y FROM part) "
       "SELECT x, round(list_sort(list(y))[greatest(CAST(ceil(0.9 * count(*) - 1e-9) AS BIGINT), 1)], 6) AS p FROM g GROUP BY x")
def boosting_quantile(spark, sf):
    """One round of quantile loss with two leaves: the value of each is the exact quantile of its rows."""
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.lit(0).alias("fold"), F.array((size > 25).cast("double")).alias("x"), (F.col("p_retailprice") + 100 * size).alias("label"))
    m = BO.fit_many(rows, [(BO.Boosting("quantile", 1, 1.0, 1, alpha=0.9), None)])[0]
    got = MX.map_rows(rows.select("x").distinct(), lambda x: m.predict(x)[:, None], "p")
    return rounded(got.select(F.col("x")[0].alias("x"), F.col("p")[0].alias("p")))


def _net(spark, sf):
    rows, _, _ = linear_part(spark, sf)
    pts = split_rows(rows, ["key"]).select(F.lit(0).alias("gid"), "key", "is_test", "fold", "x", F.array("label").alias("y"))
    s = rows.agg(F.avg(F.col("x")[0]), F.avg(F.col("x")[1]), F.stddev_pop(F.col("x")[0]), F.stddev_pop(F.col("x")[1]), F.avg("label"), F.stddev_pop("label")).first()
    net = mlp.Net(0, 0, -1, [2, 12, 1], 1e-4, np.array(s[0:2]), np.array(s[2:4]), np.array([s[4]]), np.array([s[5]]), mlp.start([2, 12, 1], 1))
    return rows, mlp.train(pts.where("NOT is_test"), [net], rounds=3)[0]


@query("integrated_gradients_net")
def integrated_gradients_net(spark, sf):
    rows, net = _net(spark, sf)
    return SH.attribution_table(SH.integrated_gradients(rows, lambda x: mlp.input_gradient(net, x)), ["p_partkey", "p_size"])


@query("gradient_shap_net")
def gradient_shap_net(spark, sf):
    rows, net = _net(spark, sf)
    return SH.attribution_table(SH.gradient_shap(rows, lambda x: mlp.input_gradient(net, x)), ["p_partkey", "p_size"])


@query("deep_shapley_net")
def deep_shapley_net(spark, sf):
    """Shapley values of a network against sampled background rows."""
    from ..operators.matrix import map_rows
    rows, net = _net(spark, sf)

    def predict(r):
        return map_rows(r.drop("features"), lambda x: mlp.forward(net, x), "__p").withColumn("p", F.col("__p")[0])

    return SH.attribution_table(SH.background_shapley(rows, predict, 2, draws=2), ["p_partkey", "p_size"])


# ---- knockoffs ---------------------------------------------------------------------------------

KO_COLS = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"]


def sales(spark, sf):
    """lineitem, with the planted target price * (1 - discount); a stored row number serves as key."""
    from ..operators.predict import with_key
    li = table(spark, sf, "lineitem").select(*KO_COLS, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    return with_key(li, None).withColumnRenamed("__key", "key")


@query("knockoff_statistics")
def knockoff_statistics(spark, sf):
    df = sales(spark, sf)
    return KO.linear_statistics(df, KO_COLS, "y", KO.fit_sampler(df, KO_COLS), [1, 2, 3], ["lasso", "ridge"])


@query("knockoff_forest")
def knockoff_forest(spark, sf):
    df = sales(spark, sf)
    return KO.forest_statistics(df, KO_COLS, "y", KO.fit_sampler(df, KO_COLS), 1, trees=10, depth=6)


@query("knockoff_rows")
def knockoff_rows(spark, sf):
    """Means of the columns and their knockoffs: both standardised."""
    df = sales(spark, sf)
    rows = KO.knockoff_rows(df, KO_COLS, KO.fit_sampler(df, KO_COLS), 1)
    return rows.select(F.posexplode("x").alias("slot", "v")).groupBy("slot").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


@query("knockoffs")
def knockoffs(spark, sf):
    return KO.simulate_knockoffs(sales(spark, sf), KO_COLS, "y", 0.3, ["lasso", "ridge"])[1]


@query("relevance")
def relevance_task(spark, sf):
    """The whole task with small limits: consensus of the model attributions."""
    out = relevance(planted(spark, sf), INPUTS, "y", {
        "keys": ["o_orderkey"], "base_models": ["briskbagging", "briskxgboost"], "n_trials": 1, "boosted_round": 5, "max_depth": 5,
        "bagging_estimators": 12, "ensemble_n_trials": 1, "ensemble_bagging_estimators": 12, "knockoff_runs": 2, "fstats": ["lasso"], "fdr": 0.3})
    a = out["xai_model"].select("feature", F.col("score").alias("model_score"))
    return a.join(out["xai_non_model"].select("feature", F.col("score").alias("knockoff_score")), "feature", "full")
