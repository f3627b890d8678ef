"""Every registered query with SQL against DuckDB, and the shape of the others."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# these train models or loop over many jobs; their operators have tests of their own
SLOW = {n for n in QUERIES if n.startswith(("refine", "model_", "compare_")) or n in ("stack", "relevance", "mlp_scan", "sammon", "intrinsic_dimension", "adaptive_reduction")}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].astype(str).replace({"nan": "None", "<NA>": "None"})
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, con, name):
    got, want = rows(QUERIES[name](spark, sf).toPandas()), rows(con.sql(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        if got[c].dtype == object or want[c].dtype == object:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
        else:
            assert np.allclose(got[c], want[c], rtol=1e-5, atol=2e-5, equal_nan=True), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs(spark, sf, name):
    assert len(QUERIES[name](spark, sf).toPandas()) > 0


def test_every_counterpart_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
