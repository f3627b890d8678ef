"""All-pairs sums: any block and tile size, groups of their own sizes, and what is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import neighbors, pairs
from colscope.operators.neighbors import block_distances, distances


def totals():
    def total(a, b):
        d = distances(a["x"], b["x"])
        return {"d": d.sum(axis=1), "w": (d * b["v"][None, :]).sum(axis=1)}

    return total


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x, v = rng.normal(size=(700, 3)), rng.normal(size=700)
    rows = [(i, r.tolist(), float(s)) for i, (r, s) in enumerate(zip(x, v))]
    return spark.createDataFrame(rows, "key bigint, x array<double>, v double"), x, v


def by_key(df, gid=None):
    t = df.toPandas().sort_values(([gid] if gid else []) + ["key"])
    return t[["d", "w"]].to_numpy()


@pytest.mark.parametrize("block_rows,tile", [(None, 512), (100, 512), (100, 17), (333, 64), (10_000, 1)])
def test_same_sums_for_any_block_and_tile(data, block_rows, tile):
    df, x, v = data
    d = distances(x, x)
    got = by_key(pairs.pair_sums(df, totals(), ["d", "w"], 700, block_rows=block_rows, tile=tile))
    assert np.allclose(got, np.column_stack([d.sum(1), d @ v]))


def test_each_group_has_blocks_of_its_own_size(spark, data):
    df, x, v = data
    small = df.where("key < 3").select(F.lit(1).alias("g"), "*", F.lit(3).alias("n"))
    both = df.select(F.lit(0).alias("g"), "*", F.lit(700).alias("n")).unionByName(small)
    got = by_key(pairs.pair_sums(both, totals(), ["d", "w"], "n", gid="g", block_rows=50), "g")
    d, e = distances(x, x), distances(x[:3], x[:3])
    assert np.allclose(got, np.vstack([np.column_stack([d.sum(1), d @ v]), np.column_stack([e.sum(1), e @ v[:3]])]))


def test_text_keys_single_row_and_empty_table(spark):
    one = spark.createDataFrame([("a", [1.0, 2.0], 3.0)], "key string, x array<double>, v double")
    assert pairs.pair_sums(one, totals(), ["d", "w"], 1).collect() == [("a", 0.0, 0.0)]
    assert pairs.pair_sums(one.where("false"), totals(), ["d", "w"], 0).count() == 0


def test_two_hundred_thousand_rows_travel_few_times(spark):
    rows = spark.range(200_000).select(F.col("id").alias("key"), F.array(*[F.col("id") * 0.1] * 5).alias("x"))
    assert -(-200_000 // pairs._largest_block(rows, ["x"])) * 8 <= -(-200_000 // 2048)


def test_block_distances_keep_their_digits():
    draw = np.random.default_rng(3)
    a = draw.normal(size=(40, 12)) + 1e4
    b = np.vstack([draw.normal(size=(30, 12)) + 1e4, a[:1], a[1:2] + 1e-7])
    got, want = block_distances(a, b), distances(a, b)
    assert np.allclose(got, want, rtol=1e-9, atol=0) and got[0, 30] == 0
    b[0, 0] = np.inf
    assert np.isinf(block_distances(a, b)[:, 0]).all() and np.allclose(block_distances(a, b)[:, 1:], want[:, 1:], rtol=1e-9, atol=0)


def test_pair_sums_of_wide_rows_need_no_pass_for_each_column(monkeypatch):
    """Before, 256 x 256 distances were summed column by column."""
    monkeypatch.setattr(neighbors, "distances", None)
    draw = np.random.default_rng(4)
    a, b = draw.normal(size=(256, 64)), draw.normal(size=(256, 64))
    assert np.allclose(neighbors.block_distances(a, b), np.linalg.norm(a[:, None] - b[None], axis=2))
