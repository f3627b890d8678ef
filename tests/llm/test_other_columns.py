"""Columns that the operators do not know, under names that they might use themselves, and very long texts: results stay the same."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from colscope.llm import bpe, chat, htmltext, jaccard, langid, neardup, quality, substrings, topk

NAMES = ["a.b", "id", "key", "x", "n", "row", "score", "p", "b", "doc", "tid", "start", "rank", "kept", "size", "n_words", "text_", "component_id", "__positive", "__id", "__text", "__html", "__b", "_1"]


def cluttered(df):
    own = set(df.columns)
    return df.select(*[F.lit("clash").alias(n) for n in NAMES if n not in own], "*")


def same(fn, *tables):
    plain, more = (sorted(map(str, fn(*t).collect())) for t in (tables, [cluttered(t) for t in tables]))
    assert plain == more and plain


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(3)
    langs = {"aa": "tala mira sol onde ver casa rio luz".split(), "bb": "grum hark stolt vinter brak und ost kelt".split()}
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(r.choice(langs[lang], 40 + i)), lang))
    rows += [(60, rows[5][1], "aa"), (61, rows[5][1] + " sol", "aa"), (62, None, "aa"), (63, "", None), (64, "solriomira" * 30_000, "aa"), (65, " ".join(["tala mira"] * 60_000), "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(4).normal(size=(80, 6))
    x[40:50] = x[:10]
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)


def test_vectors(vectors):
    same(neardup.near_duplicates, vectors)
    same(lambda v: topk.top_k(v.withColumn("q", neardup.on_grid(F.col("embedding"), 64)), F.col("vec_id") % 10 == 0, vector_col="q"), vectors)
    assert neardup.near_duplicates(vectors.limit(0)).count() == 0


def test_duplicates(docs):
    same(jaccard.jaccard_groups, docs)
    same(substrings.remove_repeats, docs)
    assert jaccard.jaccard_groups(docs.limit(0)).count() == 0 and substrings.remove_repeats(docs.limit(0)).count() == 0


def test_models(spark, docs):
    same(langid.detect, docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    same(quality.classify, docs, labels)


def test_tokens(docs):
    same(lambda d: bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=False), docs)


def test_pages(spark):
    page = lambda k: f"<html><body><nav><a href=a>Home {k}</a></nav><article><h1>Head {k}</h1><p>Text of page {k}, long enough.</p></article><footer>End</footer></body></html>"
    long = "<html><body><nav><a href=a>Home</a></nav><article>" + "<p>One more sentence, told again.</p>" * 20_000 + "</article></body></html>"
    rows = [(k, f"u{k}", page(k)) for k in range(30)] + [(100, "long", long), (101, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    same(htmltext.extract, pages)
    got = {r.page_id: r for r in htmltext.extract(pages).collect()}
    assert got[100].n_chars == 20_000 * len("One more sentence, told again. ") - 1 and got[101].text == ""


def test_chats(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", "long " * 50_000 if (c, t) == (1, 2) else f"say {c} {t}") for c in range(5) for t in range(4)] + [(None, 0, "user", "x"), (7, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(lambda d: chat.digests(chat.format_chats(chat.thread(d))), turns)
