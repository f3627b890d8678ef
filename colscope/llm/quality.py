"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and web text taken without its labels are described by counts of bytes, words and lines, whatever the language. A linear model
minimises  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))  with the logistic loss; where the second part turns
negative its gradient is reversed. The prior is the share of positives among the labelled training rows.

The fit uses at most ``limit`` positives and ``limit`` unlabelled texts, chosen by hash of the id (a parameter; the prior
counts all labels); every document is scored from its whole text in one pass without a shuffle.

Defined cases: a null text is an empty text; a document with labels of both kinds is no trusted positive; without positives or unlabelled
texts every score is the prior (0.5 without labels); repeated rows each get a score. An empty table gives an empty table; very long
texts are described whole; other columns of both tables, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .bpe import chunks
from .langid import held_out

LIMIT = 20_000
THRESHOLD = 0.3
PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)


def features(text: str) -> list[float]:
    """Shares and rates of one text; all are bounded or logarithmic."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    words, lines = text.split(), text.split("\n")
    m = max(len(words), 1)
    repeated = sum(map(eq, words, words[1:])) / m
    full = [x for x in lines if x.strip()]
    ended = sum(x.rstrip()[-1] in ".!?\"')" for x in full)
    marked = sum(not w[-1].isalnum() for w in words) / m
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    punct = count[PUNCTUATION]
    return [np.log1p(len(words)), sizes.mean() / 10, min(sizes.std() / 10, 5.0), min(sizes.max() / 50, 5.0), len(set(words)) / m, repeated, np.sqrt(repeated), upper / max(upper + lower, 1), upper / n, lower / n, digits / n,
            count[128:].sum() / n, punct.sum() / m, marked, len(lines) / m, 1 - len(set(full)) / max(len(full), 1), ended / max(len(full), 1), np.log1p(len(text) / max(len(full), 1)),
            *np.log1p(100 * punct / m), *np.minimum(punct / m, 1.0)]


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), -1)


class Model:
    """Linear scores on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) for x in (p, u))
        # derivatives of log(1 + e^-z) and log(1 + e^z)
        plus, minus_p, minus_u = sp - 1, sp, su
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() - prior * -np.log(np.maximum(1 - sp, 1e-12)).mean()
        grad = lambda d, x: np.r_[x.T @ d, d.sum()] / len(x)
        rest = grad(minus_u, u) - prior * grad(minus_p, p)
        g = prior * grad(plus, p) + rest if negative >= 0 else -rest
        g[:-1] += decay * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (1 - t / (steps + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, b)


def _described(docs: DataFrame, text_col: str, keep: list[Column | str], fn, name: str, kind: T.DataType) -> DataFrame:
    """Columns ``keep`` with what ``fn`` makes of each chunk of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], fn(texts[a:b])], names=[*batch.schema.names[1:], name])

    used = docs.select(F.col(text_col).alias("__text"), *keep)
    return used.mapInArrow(run, used.drop("__text").schema.add(name, kind))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = LIMIT) -> tuple[Model | None, float]:
    """Model and prior from the rows of ``docs`` and ``labels``; both must hold training rows only."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    n, good = known.agg(F.count("*"), F.sum((F.col("low") == 1).cast("long"))).first()
    prior = min(max((good or 0) / n, 0.01), 0.99) if n else 0.5
    ids = docs.filter(F.col(text_col).isNotNull()).select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    order = F.xxhash64(F.lit(5), F.col(id_col))
    total = ids.count()
    # a hash threshold near the bound first, so that the ordering below sees few rows
    near = lambda df, size: df.filter(F.pmod(order, F.lit(1 << 30)) < int(min(1.0, 1.5 * limit / max(size, 1)) * (1 << 30)))
    positive = near(known.filter("low = 1").select(id_col), good or 0).join(ids, id_col, "left_semi").orderBy(order).limit(limit)
    # any text without its label, so that the pool has the prior's share of positives
    free = near(ids, total).orderBy(order).limit(limit)
    # at most 2 * limit ids, whatever the input
    chosen = positive.withColumn("__positive", F.lit(True)).unionByName(free.withColumn("__positive", F.lit(False)))
    # one text for an id, however often it comes
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col, "__positive").agg(F.min(text_col).alias(text_col))
    vectors = lambda texts: pa.array(_matrix(texts).tolist(), pa.list_(pa.float64()))
    got = _described(sample, text_col, ["__positive"], vectors, "x", T.ArrayType(T.DoubleType())).toPandas() if n else None
    if got is None or not got["__positive"].any() or got["__positive"].all():
        return None, prior
    x, positive = np.array(got["x"].tolist(), np.float64), got["__positive"].to_numpy(bool)
    return fit(x[positive], x[~positive], prior), prior


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = LIMIT) -> DataFrame:
    """id, held_out, score, predicted of every row; learns only where crc32(id) mod 5 is not 0."""
    out = F.coalesce(held_out(id_col, 5, 0), F.lit(False))
    model, prior = train(docs.filter(~out), labels.filter(~out), id_col, text_col, label_col, limit)
    scores = (lambda texts: pa.array(model.score(_matrix(texts)))) if model else (lambda texts: pa.array(np.full(len(texts), prior)))
    got = _described(docs, text_col, [id_col, out.alias("held_out")], scores, "score", T.DoubleType())
    return got.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
