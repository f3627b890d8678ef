"""Languages of a document as a mixture: expectation-maximisation over words, whose likelihoods come from letter trigrams.

Training counts the trigrams of all words of the labelled documents per language: tasks send sums per (language, bucket), so the model has
at most ``BUCKETS`` numbers per language whatever the corpus. A document's words are draws from a mixture of languages; proportions are
found by expectation-maximisation, languages join the set one by one while the likelihood, less half the logarithm of the number of
words per language, grows.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is everything when no language was learned;
equal likelihoods go to the first language in order; documents are independent, repeated rows each get their row. An empty table gives an
empty table; very long texts are counted whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import chunks
from .memory import lean

BUCKETS = 1 << 16
SMOOTH = 0.1
STEPS = 15
WORDS = re.compile(r"[^\W\d_]+")


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document number and word number of every word, and the distinct words."""
    rows = [WORDS.findall(t.lower()) for t in texts]
    docs = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    codes, words = pd.factorize(np.array([w for r in rows for w in r], dtype=object))
    good = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))
    if not good.all():
        keep = good[codes]
        docs, codes = docs[keep], codes[keep]
    return docs, codes, list(words)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of every letter trigram, with a blank at both ends of a word."""
    text = np.frombuffer(("\n".join(words)).join("\n\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if len(text) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = (text[:-2] * np.uint64(0x9E3779B185EBCA87) + text[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + text[2:]) * np.uint64(0xD6E8FEB86659FD93)
    buckets = (mixed >> np.uint64(48)).astype(np.int64)
    # a word of n letters has n trigrams; the one that spans a line end belongs to no word
    owner = np.repeat(np.arange(len(words)), sizes + 1)[:len(buckets)]
    inside = text[1:-1] != 10
    return owner[inside], buckets[inside]


def count_trigrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Sums (lang, bucket, n) over all documents with a text and a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for a, b in chunks(texts):
                at, codes, words = split_words(texts[a:b])
                owner, buckets = trigrams(words)
                for lang in set(langs[a:b]):
                    weight = np.bincount(codes[(langs[a:b] == lang)[at]], minlength=len(words))
                    sums[lang] = sums.get(lang, 0) + np.bincount(buckets, weights=weight[owner], minlength=BUCKETS)
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used].astype(np.int64))], names=["lang", "bucket", "n"])

    used = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, F.col(lang_col).cast("string"))
    return used.mapInArrow(lean(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities [BUCKETS, languages]: what is sent to the driver is bounded by that."""
    got = count_trigrams(docs, text_col, lang_col).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[got["bucket"].to_numpy(), np.searchsorted(langs, got["lang"].to_numpy().astype(str))] = got["n"].to_numpy() if len(got) else 0
    return langs, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def proportions(like: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: shares [docs, languages] within ``allowed``, and log likelihoods (of the scaled ``like``)."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    total = _sums(n, starts)[:, None]
    for _ in range(STEPS):
        w = pi[doc] * like
        w *= (n / np.maximum(w.sum(axis=1), 1e-300))[:, None]
        pi = _sums(w, starts) / total
    return pi, _sums(n * np.log(np.maximum((pi[doc] * like).sum(axis=1), 1e-300)), starts)


def infer(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the leading language (-1: none) and score of every text."""
    lead, score = np.full(len(texts), -1), np.zeros(len(texts))
    at, codes, words = split_words(texts)
    if not len(at) or not table.shape[1]:
        return lead, score
    owner, buckets = trigrams(words)
    bounds = np.searchsorted(owner, np.arange(len(words)))
    logs = np.add.reduceat(table[buckets].astype(np.float64), bounds, axis=0)
    pairs, n = np.unique(at * len(words) + codes, return_counts=True)
    doc, logs, n = pairs // len(words), logs[pairs % len(words)], n.astype(np.float64)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    ids = doc[starts]
    doc = np.searchsorted(ids, doc)
    alone = _sums(logs * n[:, None], starts)
    first = alone.argmax(axis=1)
    d, size = np.arange(len(ids)), _sums(n, starts)
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(logs - top, -600.0))
    base = _sums(n * top[:, 0], starts)
    fine = np.exp(np.minimum(0, alone - alone.max(axis=1, keepdims=True)))
    sure = 1 / fine.sum(axis=1)  # how far ahead the single best language is
    share = np.ones(len(ids))
    # the likeliest second language: the one that helps most when words may come from either
    own = like[np.arange(len(doc)), first[doc]]
    gain = _sums(n[:, None] * np.log((own[:, None] + like) / 2), starts)
    gain[d, first] = -np.inf
    allowed = np.zeros((len(ids), like.shape[1]))
    allowed[d, first] = 1
    best = alone[d, first] - base
    price = np.log(np.maximum(size, 2)) / 2
    open_ = d
    for _ in range(like.shape[1] - 1):
        trial = allowed[open_]
        trial[np.arange(len(open_)), np.where(trial > 0, -np.inf, gain[open_]).argmax(axis=1)] = 1
        part = np.isin(doc, open_)
        begin = np.flatnonzero(np.r_[True, np.diff(doc[part]) != 0])
        pi, ll = proportions(like[part], n[part], np.searchsorted(open_, doc[part]), begin, trial)
        better = ll - price[open_] > best[open_]
        won = open_[better]
        if not len(won):
            break
        allowed[won], best[won] = trial[better], ll[better] - price[won]
        first[won], share[won] = pi[better].argmax(axis=1), pi[better].max(axis=1)
        sure[won] = 1.0
        open_ = won
    lead[ids], score[ids] = first, np.clip(share * sure, 0, 1)
    return lead, score


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with lang_pred and score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in chunks(texts):
                lead, score = infer(texts[a:b], table)
                names = [langs[k] if k >= 0 else "und" for k in lead]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names[1:], "lang_pred", "score"])

    used = docs.select(F.col(text_col).alias("__text"), *keep)
    schema = used.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return used.mapInArrow(lean(run), schema)


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learns from the rows whose crc32(id) mod 3 is not 1 and predicts all: ``keep`` (the id), held_out, lang_pred, score."""
    out = F.coalesce(held_out(id_col, 3, 1), F.lit(False))
    langs, table = learn(docs.filter(~out), text_col, lang_col)
    return predict(docs, langs, table, [*(keep or [id_col]), out.alias("held_out")], text_col)
