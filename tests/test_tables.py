import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colscope.operators import clean as C, combine as K, profile as P, quantiles as Q, ranking as R
from colscope.operators.order import with_position


@pytest.mark.parametrize("few", [0, 4000])
def test_exact_quantiles_by_bracket_search(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "GATHER", 5)
    monkeypatch.setattr(Q, "BINS", 4)
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=700), 2)
    x[:300] = 0.25  # a hot value
    y = rng.exponential(size=700) ** 4
    got = Q.exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), ["x", "y"], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert np.allclose(got["x"], np.quantile(x, [0, 0.25, 0.5, 0.9, 1]))
    assert np.allclose(got["y"], np.quantile(y, [0, 0.25, 0.5, 0.9, 1]))


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert Q.exact_quantiles(df, ["x"], [0.5])["x"] == [2.0]
    assert P.na_counts(df).first()["n_missing"] == 2


def test_positions_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = with_position(df, ["v"]).toPandas()
    assert (got["v"] == got["position"]).all()


def test_label_codes_are_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "s string")
    got = sorted(r["s"] if r["s"] is not None else -1 for r in C.label_encode(df, ["s"]).collect())
    assert got == [-1, 0, 1, 1, 2]


def test_bad_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5, None), (2.0, float("inf"), 5, None)], "a double, b double, c int, d int")
    assert C.bad_columns(df, ["a", "b", "c"]) == ["b"]
    assert {r["column"]: r["is_constant"] for r in C.constant_columns(df).collect()} == {"a": False, "b": False, "c": True, "d": True}
    assert C.blank_constants(df).select("c").first()["c"] is None


def test_sentinels_and_casts(spark):
    df = spark.createDataFrame([("UNKNOWN   ", "7"), ("NONE      ", "x"), (" ", "1.5"), ("ok", "???????")], "t string, n string")
    out = C.convert_types(df, floats=["n"]).collect()
    assert [r["t"] for r in out] == [None, "NONE", None, "ok"]
    assert [r["n"] for r in out] == [7.0, None, 1.5, None]


def test_reduction_sizes(spark):
    assert C.reduced_size(249, 10) == 249
    assert C.reduced_size(1000, 100) == 500
    assert C.reduced_size(100_000, 3) == 8000
    df = spark.range(20_000)
    n = C.reduce_rows(df, ["id"], n_cols=3).count()
    assert abs(n - 1600) < 200
    assert C.reduce_rows(df.repartition(7), ["id"], n_cols=3).count() == n


def test_names():
    assert C.exclude_names(["a", "b", "c"], ["All"]) == ["a", "b", "c"]
    assert C.exclude_names(["a", "b", "c"], ["!b"]) == ["a", "c"]
    assert C.exclude_names(["a", "b", "c"], ["c"]) == ["c"]


def test_categories_take_the_last_match(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "parameter string")
    got = {r["parameter"]: r["category"] for r in C.categorize(df, [("p", ["x", "y"]), ("q", ["y"])]).collect()}
    assert got == {"x": "p", "y": "q", "z": None}


def test_combinations():
    assert len(K.get_column_combinations([1, 2, 3, 4, 5, 6], 3, 1, [5, 6])) == 8
    for n, i, o, t in ((6, 3, 1, [5, 6]), (6, 2, 2, None), (5, 1, 1, None)):
        cols = list(range(1, n + 1))
        assert len(K.get_column_combinations(cols, i, o, t)) == K.get_column_combinations(cols, i, o, t, amount_only=True)
    assert K.count_combinations(range(9), 3, 2) == math.comb(9, 3) * math.comb(6, 2)
    with pytest.raises(ValueError):
        K.get_column_combinations([1, 2], 2, 1)
    with pytest.raises(ValueError):
        K.get_column_combinations([1, 2, 3], 1, 2, [3])


def test_max_rank_and_consensus(spark):
    rows = [("m1", "a", 3.0), ("m1", "b", 1.0), ("m1", "c", 3.0), ("m2", "a", None), ("m2", "b", 2.0), ("m2", "c", 1.0)]
    r = R.max_rank(spark.createDataFrame(rows, "method string, feature string, score double"), ["method"])
    got = {(x["method"], x["feature"]): x["rank"] for x in r.collect()}
    assert got == {("m1", "a"): 3, ("m1", "b"): 0, ("m1", "c"): 3, ("m2", "a"): 3, ("m2", "b"): 2, ("m2", "c"): 0}
    score = {x["feature"]: x["score"] for x in R.consensus(r).collect()}
    assert score == {"a": 3.0, "b": 1.0, "c": 1.5}


def test_fdr_threshold_by_definition(spark):
    rng = np.random.default_rng(3)
    w = np.round(rng.normal(0.7, 1, 40), 1)
    df = spark.createDataFrame([(0, f"f{i}", float(v)) for i, v in enumerate(w)], "g int, feature string, w double")
    want = min((t for t in np.abs(w) if t > 0 and (1 + (w <= -t).sum()) / max(1, (w >= t).sum()) <= 0.25), default=None)
    assert R.fdr_thresholds(df, 0.25, ["g"]).first()["threshold"] == want
