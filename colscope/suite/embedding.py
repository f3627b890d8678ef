"""Registered queries on embeddings, their quality and the intrinsic dimension."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators import linear_dim as L, nonlinear_dim as N, quality as Q
from ..operators.gram import table_moments
from ..operators.matrix import as_matrix, matrix_moments, standardize_matrix
from ..plans import complexity as CX
from ..session import cut, scratch_path
from ..streaming.incremental import merged_components, stream_moments
from .common import query, rounded, table, union_all


def matrix(spark, sf):
    return as_matrix(table(spark, sf, "embeddings"), "vec_id", "embedding")


def first_two(spark, sf):
    """Rows with their first two components as a stand-in embedding."""
    return matrix(spark, sf).withColumn("y", F.slice("x", 1, 2))


RANKS = ("WITH e AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.k AS i, b.k AS j, list_distance(a.v, b.v) AS hi, list_distance(a.v[1:2], b.v[1:2]) AS lo FROM e a, e b), "
         "r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY hi, j) - 1 AS rh, row_number() OVER (PARTITION BY i ORDER BY lo, j) - 1 AS rl FROM d) ")


@query("coranking", RANKS + "SELECT rh AS rank_high, rl AS rank_low, count(*) AS n FROM r WHERE rh > 0 AND rl > 0 GROUP BY 1, 2")
def coranking(spark, sf):
    return Q.coranking(first_two(spark, sf))


@query("embedding_quality", RANKS + "SELECT CAST(sqrt(count(*)) AS INTEGER) AS n, round(1 - avg(abs(rh - rl)) / ((sqrt(count(*)) - 1) / 2), 6) AS rel_err, "
       "round(1 - sum((rh - rl) * (rh - rl)) / (count(*) * var_pop(rh)), 6) AS r2 FROM r")
def embedding_quality(spark, sf):
    return rounded(Q.quality_table(first_two(spark, sf)))


@query("embedding_stress", "WITH e AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT list_distance(a.v, b.v) AS hi, list_distance(a.v[1:2], b.v[1:2]) AS lo FROM e a, e b WHERE a.k <> b.k) "
       "SELECT round(sum((hi - lo) * (hi - lo) / hi), 4) AS sammon, round(avg((hi - lo) * (hi - lo) * CAST(lo < 1.0 AS INTEGER)), 6) AS local FROM d")
def embedding_stress(spark, sf):
    both = cut(first_two(spark, sf), "stress")
    n = both.count()
    return spark.createDataFrame([(round(N.stress(both, n, sammon=True), 4), round(N.stress(both, n, limit=1.0), 6))], "sammon double, local double")


@query("pca_2", "WITH s AS (SELECT avg(l_quantity) m1, stddev_pop(l_quantity) d1, avg(l_extendedprice) m2, stddev_pop(l_extendedprice) d2, corr(l_quantity, l_extendedprice) r, count(*) n FROM lineitem) "
       "SELECT round((1 + abs(r)) * n / (n - 1), 6) AS value1, round((1 - abs(r)) * n / (n - 1), 6) AS value2 FROM s")
def pca_2(spark, sf):
    """Two scaled columns: the eigenvalues are one plus and minus their correlation."""
    from ..operators.clean import standardize
    df = standardize(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    p = L.pca_from(table_moments(df, ["l_quantity", "l_extendedprice"]), 2)
    return rounded(spark.createDataFrame([(float(p.values[0]), float(p.values[1]))], "value1 double, value2 double"))


@query("matrix_covariance", "SELECT i - 1 AS i, j - 1 AS j, round(covar_samp(v[i], v[j]), 8) AS cov FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings), range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY 1, 2")
def matrix_covariance(spark, sf):
    cov = matrix_moments(matrix(spark, sf), 64)[0].cov
    rows = [(i, j, float(cov[i, j])) for i in range(64) for j in range(i, 64)]
    return rounded(spark.createDataFrame(rows, "i bigint, j bigint, cov double"), 8)


@query("svd_gram", "SELECT round(sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2), 4) AS s1, round(sqrt((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2), 4) AS s2 FROM "
       "(SELECT sum(l_quantity * l_quantity) a, sum(l_quantity * l_linenumber) b, sum(l_linenumber * l_linenumber) c FROM lineitem)")
def svd_gram(spark, sf):
    """Singular values of two uncentred columns."""
    df = table(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("k"), "l_quantity", "l_linenumber")
    s = L.truncated_svd(as_matrix(df, "k", ["l_quantity", "l_linenumber"]), 2).values
    return rounded(spark.createDataFrame([(float(s[0]), float(s[1]))], "s1 double, s2 double"), 4)


@query("incremental_moments", "SELECT round(covar_samp(v[1], v[1]), 8) AS c00, round(covar_samp(v[1], v[2]), 8) AS c01, round(avg(v[1]), 8) AS m0, count(*) AS n FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def incremental_moments(spark, sf):
    """Moments of hash batches, merged, equal those of the whole."""
    m = matrix(spark, sf)
    lot = F.pmod(F.xxhash64("key"), F.lit(3))
    mo = L.merge_moments([matrix_moments(m.where(lot == b), 64)[0] for b in range(3)])
    return rounded(spark.createDataFrame([(float(mo.cov[0, 0]), float(mo.cov[0, 1]), float(mo.mean[0]), int(mo.n))], "c00 double, c01 double, m0 double, n bigint"), 8)


@query("incremental_stream")
def incremental_stream(spark, sf):
    """Batches arriving as a stream; components of all of them."""
    src, out, chk = (scratch_path(spark, x) for x in ("in", "moments", "chk"))
    matrix(spark, sf).repartition(3).write.parquet(src)
    stream = spark.readStream.schema("key bigint, x array<double>").option("maxFilesPerTrigger", 1).parquet(src)
    stream_moments(stream, out, chk).awaitTermination()
    p = merged_components(spark, out, 4)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(p.values)], "component int, value double")


# two scaled columns of the orders: the directions are (1, 1) and (1, -1) up to sign, the eigenvalues one plus and minus the correlation
TWO = ("WITH o AS (SELECT l_orderkey AS key, sum(l_quantity) AS a, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1), s AS (SELECT avg(a) ma, stddev_pop(a) da, avg(b) mb, stddev_pop(b) db, corr(a, b) AS r, count(*) AS n FROM o), "
       "z AS (SELECT key, (a - ma) / da / sqrt(2) AS u, sign(r) * (b - mb) / db / sqrt(2) AS v, (1 + abs(r)) * n / (n - 1) AS l1, (1 - abs(r)) * n / (n - 1) AS l2 FROM o, s) ")
PLAIN = ("pca", "truncated_svd", "classical_scaling")


def two_columns(spark, sf):
    o = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum("l_quantity").alias("a"), F.sum("l_extendedprice").alias("b"))
    m = cut(as_matrix(o, "key", ["a", "b"]), "two")
    return cut(standardize_matrix(m, matrix_moments(m, 2)[0]), "scaled")


@query("incremental_stream_2", TWO + "SELECT DISTINCT 0 AS component, round(l1, 6) AS value FROM z UNION ALL SELECT DISTINCT 1, round(l2, 6) FROM z")
def incremental_stream_2(spark, sf):
    """Eigenvalues of two scaled columns whose rows arrive as a stream, with totals made on the way."""
    src, out, chk = (scratch_path(spark, x) for x in ("in", "moments", "chk"))
    two_columns(spark, sf).select("key", "x").repartition(5).write.parquet(src)
    stream = spark.readStream.schema("key bigint, x array<double>").option("maxFilesPerTrigger", 1).parquet(src)
    stream_moments(stream, out, chk, every=2).awaitTermination()
    p = merged_components(spark, out, 2)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p.values)], "component int, value double"))


@query("linear_scores_2", TWO + union_all([f"SELECT '{n}' AS method, key, round(abs(u + v), 6) AS first, round(abs(u - v), 6) AS second FROM z" for n in PLAIN]
       + ["SELECT 'probabilistic_pca', key, round(abs(u + v) * sqrt(l1 - l2) / l1, 6), NULL FROM z"]))
def linear_scores_2(spark, sf):
    """Scores of the linear embeddings of two scaled columns; the probabilistic one in one dimension, as two leave no noise."""
    m, out = two_columns(spark, sf), []
    for n in PLAIN:
        out.append(getattr(L, n)(m, 2).transform(m.select("key", "x")).select(F.lit(n).alias("method"), "key", F.abs(F.col("y")[0]).alias("first"), F.abs(F.col("y")[1]).alias("second")))
    p = L.probabilistic_pca(m, 1).transform(m.select("key", "x"))
    out.append(p.select(F.lit("probabilistic_pca").alias("method"), "key", F.abs(F.col("y")[0]).alias("first"), F.lit(None).cast("double").alias("second")))
    return rounded(reduce(DataFrame.unionByName, out))


def _scores(spark, sf, fn, k=8):
    m = cut(matrix(spark, sf), "matrix")
    return fn(m, k).select("key", F.posexplode("y").alias("component", "value"))


@query("pca_k")
def pca_k(spark, sf):
    return _scores(spark, sf, lambda m, k: L.pca(m, k).transform(m))


@query("svd_k")
def svd_k(spark, sf):
    return _scores(spark, sf, lambda m, k: L.truncated_svd(m, k).transform(m))


@query("classical_scaling")
def classical_scaling(spark, sf):
    return _scores(spark, sf, lambda m, k: L.classical_scaling(m, k).transform(m))


@query("ppca")
def ppca(spark, sf):
    return _scores(spark, sf, lambda m, k: L.probabilistic_pca(m, k).transform(m))


@query("robust_pca")
def robust_pca(spark, sf):
    return _scores(spark, sf, lambda m, k: L.robust_pca(m, k).transform(m))


@query("sparse_pca")
def sparse_pca(spark, sf):
    return _scores(spark, sf, lambda m, k: L.sparse_pca(m, k, alpha=0.001).transform(m))


@query("adaptive_reduction")
def adaptive_reduction(spark, sf):
    return _scores(spark, sf, lambda m, k: L.adaptive_reduction(m, k).transform(m), 4)


@query("curvilinear")
def curvilinear(spark, sf):
    return _scores(spark, sf, lambda m, k: N.curvilinear(m, k), 4)


@query("proximity")
def proximity(spark, sf):
    return _scores(spark, sf, lambda m, k: N.proximity(m, k), 4)


@query("sammon")
def sammon(spark, sf):
    return _scores(spark, sf, lambda m, k: N.sammon(m, k), 2)


def low_rank(spark, sf):
    """Embeddings mixed down to three directions in eight columns."""
    mix = np.round(np.random.default_rng(7).normal(size=(3, 8)), 3)
    x = F.array(*[sum((F.col("embedding")[i].cast("double") * float(mix[i, j]) for i in range(3)), F.lit(0.0)) for j in range(8)])
    return table(spark, sf, "embeddings").select("vec_id", x.alias("x"))


@query("target_dimension")
def target_dimension(spark, sf):
    """rel_err of every probed dimension and the smallest that holds the cutoff."""
    m = cut(as_matrix(low_rank(spark, sf), "vec_id", "x"), "matrix")
    n = m.count()
    dim, trace = CX.target_dimension(m, n, 0.99)
    return spark.createDataFrame([(r["dim_low"], float(r["rel_err"]), dim) for r in trace], "dim_low int, rel_err double, target int")


@query("best_trials", "SELECT fun_id, trial, rel_err FROM (SELECT l_returnflag AS fun_id, l_linenumber AS trial, round(avg(l_discount), 6) AS rel_err, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(avg(l_discount), 6) DESC, l_linenumber) AS r "
       "FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def best_trials(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("fun_id"), F.col("l_linenumber").alias("trial")).agg(F.round(F.avg("l_discount"), 6).alias("rel_err"))
    return CX.best_trials(t).select("fun_id", "trial", "rel_err")


@query("method_search")
def method_search(spark, sf):
    """Parameter trials of one method."""
    m = cut(as_matrix(low_rank(spark, sf), "vec_id", "x"), "matrix")
    rows = CX.search_method("r_rpcag", m, 3, m.count(), budget=lambda p: (2, 2))
    return spark.createDataFrame([(i, r["hyperparameters"], float(r["rel_err"]), r["status"]) for i, r in enumerate(rows)], "trial int, hyperparameters string, rel_err double, status string")


@query("intrinsic_dimension")
def intrinsic_dimension(spark, sf):
    """The whole task on linear methods."""
    dim, _, summary = CX.complexity(low_rank(spark, sf), keys=["vec_id"], matrix_col="x", cutoff_loss=0.99,
                                    functions=["py_pca", "py_truncated_svd", "r_rpcag"], budget=lambda p: (1, 0))
    return summary.select("trial", "step", "fun_id", "dim_low", "rel_err", "status").withColumn("dimension", F.lit(dim))
