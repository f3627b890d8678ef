"""The registered queries of the numbered operators, and the pipeline stage by stage."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colscope.llm import suite
from colscope.session import cut
from test_operators import WORD, documents, jaccard_brute, windows_brute

QUERIES, ORACLE = suite.load()
TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].astype(str) if df[c].dtype == object else df[c].astype(float)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    pd.testing.assert_frame_equal(rows(QUERIES[name](spark, sf).toPandas()), rows(con.sql(ORACLE[name]).df()), check_dtype=False, rtol=1e-9)


def test_bpe_query_decodes_every_text(spark, sf):
    got = QUERIES["op7_byte_bpe"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert got.filter(F.sha2("text", 256) != F.col("decoded_sha256")).isEmpty()


def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lang = QUERIES["op9_language_mixture"](spark, sf).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang["lang"] == lang["lang_pred"]).mean() > 0.97
    good = QUERIES["op5_pu_quality"](spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
    assert (good["quality"] == good["predicted"]).mean() > 0.85


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        assert name == "language" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        by[name] = docs = cut(stage(spark, docs, sf), name)
    first = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    named = [(x.doc_id, x.text) for x in by["language"].collect()]
    assert len(named) >= 0.99 * len(first)
    groups = jaccard_brute(named)
    unique = [(x.doc_id, x.text) for x in by["near_duplicates"].collect()]
    assert sorted(i for i, _ in unique) == sorted(i for i, (_, c) in groups.items() if i == c)
    left = windows_brute(unique)
    assert {x.doc_id: x.text.split() for x in by["passages"].collect()} == {i: w for i, (n, gone, w) in left.items() if gone == 0 or gone < n}
    stream = by["source_mix"].toPandas()
    count = lambda t: len(WORD.findall(t))
    assert abs(stream["text"].map(count).sum() - sum(count(x.text) for x in by["passages"].collect())) <= stream["source"].nunique() + 1
    assert by["tokens"].count() == len(stream) and by["tokens"].filter("length(ids) != 4 * n_tokens").isEmpty()


def test_pipeline_on_awkward_rows(spark, tmp_path):
    text = "the river runs to the sea and then it rests for a while near the old stone mill by the road " * 3
    some = documents(spark, [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "x" + text, "en", None), (5, "12 34", "en", "b"), (6, "word " * 30_000, "en", "b"), (None, "free words here", None, None)])
    for name, df in (("full", some), ("empty", some.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(got) > 0) == (name == "full")
