"""Hashing of long and hostile words, rows and columns of the pipeline, memory of tasks."""

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import documents

from colscope.llm import jaccard, substrings, words


def thue_morse(bits):
    s = "a"
    for _ in range(bits):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("bits", [8, 10, 11, 12])
def test_hostile_words_differ(spark, bits):
    one = thue_morse(bits)
    two = one.translate(str.maketrans("ab", "ba"))
    w = words.Words([one.encode(), two.encode(), one.encode()])
    assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2]
    pad = " ".join(f"w{k}" for k in range(30))
    got = {r.doc_id: r for r in substrings.remove_repeats(documents(spark, [(1, " ".join([one] * 31)), (2, " ".join([two] * 31)), (3, pad)])).collect()}
    assert got[2].n_removed == got[1].n_removed and got[3].n_removed == 0  # each repeats its own windows only, from the second on
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(documents(spark, [(1, f"{one} x y z q"), (2, f"{two} x y z q")])).collect()}
    assert groups == {1: 1, 2: 2}


def test_word_hashes_follow_the_bytes():
    draw = np.random.default_rng(0)
    texts = [bytes(draw.integers(97, 100, int(n)).astype(np.uint8)) for n in draw.integers(1, 40, 3000)] + [b"a" * n for n in (7, 8, 9, 16, 511, 512, 513, 5000)]
    w = words.Words(texts)
    assert len(w.hash) == len(texts) and len(set(w.hash.tolist())) == len(set(texts))
    again = words.Words([b"zz " + t for t in texts])
    assert (again.hash[1::2] == w.hash).all()  # wherever the word stands


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, __text int, __id int, `row` string, id string")


def test_near_duplicates_go_by_row(spark):
    text = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"else{k}" for k in range(40))
    rows = [(3, text, "en", "s", 1, "x", 1, 1, "r", "i"), (5, text, "en", "s", 1, "x", 1, 1, "r", "i"), (5, other, "en", "s", 1, "x", 1, 1, "r", "i"), (None, text, "en", "s", 1, "x", 1, 1, "r", "i"),
            (None, None, None, None, None, None, None, None, None, None), (7, "", "en", "s", 0, "x", 2, 1, "r", "i"), (7, "", "en", "s", 0, "x", 3, 1, "r", "i")]
    docs = frame(spark, rows)
    got = cp.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in got.collect() if r.text) == [(3, text), (5, other)]
    assert sorted(str(r.doc_id) for r in got.collect() if not r.text) == ["7", "None"]
    assert sorted(map(str, got.collect())) == sorted(map(str, cp.near_duplicates(spark, docs.repartition(5), "").collect()))


def test_columns_come_along_under_any_name(spark):
    base = "der hund und die katze gehen in den wald und sehen viele baeume am see heute"
    rows = [(i, f"{base} nummer {i} " + " ".join(f"wort{i}x{k}" for k in range(25)), "de", "s", 1, f"v{i}", i, i, "r", "i") for i in range(1, 9)]
    docs = frame(spark, rows)
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert {(r.doc_id, r["a.b"], r["__text"]) for r in got.collect()} <= {(r[0], r[5], r[6]) for r in rows}
    assert cp.tokens(spark, docs, "").count() == 8


def test_pipeline_of_nothing(spark):
    docs = frame(spark, []).filter(F.lit(True))
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "").count() == 0
