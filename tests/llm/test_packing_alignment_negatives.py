"""Packing, tokenizer alignment and hard negatives against the tokenizer libraries and brute force, and on the awkward cases."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import documents
from tokenizers import Tokenizer

from colscope.llm import alignment, negatives, packing

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = ["", None, " ", "  two  spaces ", " lead", "trail ", "a\n\nb c\td", "tab\t x", " nb sp x", "naïve café 東京 は 😀 x́", "don't we'll it's 12 3456", "a \x1c b \x85c", "<|endoftext|> x <s> </s>",
           "under▁mark", "\x00 zero", " em space 　 wide", "x" * 3000, "<0x41> y", "same text here", "same text here", "word " * 4000, " \n x", "a \n", "\r\n line \r\n"]


def rows_of(texts):
    return list(enumerate(texts)) + [(None, "a row without id"), (None, "a row without id"), (None, "another")]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + AWKWARD


# -- packing

def test_windows_hold_every_item_once():
    draw = np.random.default_rng(0)
    for sizes in (draw.integers(1, 2048, 700), np.full(30, 2048), np.full(50, 1025), np.array([5]), np.r_[np.full(9, 1024), draw.integers(1, 500, 90)]):
        windows = packing.pack_sizes(sizes)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert max(sizes[w].sum() for w in windows) <= 2048


def test_differencing_balances():
    sums, windows = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sums.tolist() == [16, 14]  # the textbook case: 8 against 7, 6 against 5, 4 against the differences
    assert sorted(i for w in windows for i in w) == [0, 1, 2, 3, 4]
    sizes = np.random.default_rng(1).integers(1, 300, 900)
    sums, _ = packing.differencing(sizes, 60)
    assert sums.sum() == sizes.sum() and len(sums) == 60 and sums[0] - sums[-1] <= 10


def test_pack_documents(spark, texts):
    tokenizer = Tokenizer.from_file(A)
    want = Counter()
    for i, t in rows_of(texts):
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    got = packing.pack(documents(spark, rows_of(texts)), A).toPandas()
    assert set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"}
    by_sequence = got.sort_values(["sequence_id", "offset"])
    for _, g in by_sequence.groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    sums = by_sequence.groupby("sequence_id")["length"].sum()
    assert len(sums) <= -(-sums.sum() // 2048) + 3  # a piece group adds a few windows at most
    assert (got["ids"].map(zlib.crc32) == got["ids_crc32"]).all() and (got["ids"].map(len) == 4 * got["length"]).all()
    made = Counter()
    for i, own in got.sort_values("start").groupby("doc_id", dropna=False):
        if i != i:  # rows without id, of one piece each
            made.update((None, struct.unpack(f"<{len(x) // 4}I", x)) for x in own["ids"])
        else:
            raw = b"".join(own["ids"])
            assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and (own["doc_tokens"] == len(raw) // 4).all()
            made[int(i), struct.unpack(f"<{len(raw) // 4}I", raw)] += 1
    assert made == want


def test_pack_without_ids_and_empty(spark):
    some = documents(spark, [(1, "a b"), (1, "a b"), (None, None)])
    got = packing.pack(some, A, keep_ids=False).toPandas()
    assert sorted(got["doc_tokens"]) == [1, 3, 3] and "ids" not in got
    assert packing.pack(some.limit(0), A).count() == 0


# -- alignment

def aligned_brute(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    links, groups, sizes = [], [], []
    for t in texts:
        x = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        bx, by = [bytes(back[c] for c in a.id_to_token(i)) for i in x], [bytes_b(i) for i in y]
        if not t or b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
            links.append([]), groups.append(""), sizes.append((0, 0, 0))
            continue
        ex, ey = np.cumsum([len(p) for p in bx]), np.cumsum([len(p) for p in by])
        own, text, i, j = [], [], 0, 0
        for e in sorted(set(ex.tolist()) & set(ey.tolist())):
            p, q = int(np.searchsorted(ex, e)) + 1, int(np.searchsorted(ey, e)) + 1
            text.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            for k in range(i, p):
                for m in range(j, q):
                    if ex[k] - len(bx[k]) < ey[m] and ey[m] - len(by[m]) < ex[k]:
                        own.append((x[k], y[m]))
            i, j = p, q
        links.append(own), groups.append(";".join(text)), sizes.append((len(x), len(y), len(text)))
    count = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    return [(*s, len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(g.encode()).hexdigest() if g else "", g) for s, own, g in zip(sizes, links, groups)]


@pytest.mark.parametrize("bound", [alignment.BOUND, 300])
def test_align(spark, texts, bound):
    want = aligned_brute(texts)
    got = alignment.align(documents(spark, list(enumerate(texts))), A, B, bound=bound).toPandas().sort_values("doc_id")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert list(got[names].itertuples(index=False, name=None)) == want
    assert sum(w[0] == 0 for w in want) >= 2  # the empty text and those that are not given back


def test_align_copies_and_empty(spark):
    some = documents(spark, [(1, "one two"), (1, "one two"), (None, None)])
    got = alignment.align(some, A, B, keep_groups=False).toPandas()
    assert sorted(got["n_a"]) == [0, 2, 2] and set(got.loc[got["n_a"] > 0, "count_sum"]) == {4} and "groups" not in got
    assert alignment.align(some.limit(0), A, B).count() == 0


# -- hard negatives

def mined_brute(rows, anchors):
    good = sorted({(i, lab, tuple(x)) for i, lab, x in rows if i is not None and lab is not None and x and all(v is not None and np.isfinite(v) for v in x)})
    out = []
    for i, lab, x in good:
        if i % anchors:
            continue
        other = [(sum(int(p) * int(q) for p, q in zip(x, y)), j, m) for j, m, y in good if j != i and len(y) == len(x)]
        for ps, p, _ in sorted((o for o in other if o[2] == lab), key=lambda o: (-o[0], o[1]))[:5]:
            far = sorted((o for o in other if o[2] != lab and 30 * ps <= 100 * o[0] <= 90 * ps), key=lambda o: (-o[0], o[1]))[:10]
            out += [(i, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, anchors=10):
    df = spark.createDataFrame([(*r, "z", 1.0) for r in rows], "vec_id long, label int, x array<double>, code string, along double").repartition(3)
    got = negatives.mine(df, F.col("vec_id") % anchors == 0)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def vectors(seed, n, dim, labels=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 80) for _ in range(dim)] for _ in range(5)]
    return [(i, r.randrange(labels), [float(round(c + r.gauss(0, 40))) for c in r.choice(centres)]) for i in range(n)]


def test_intervals_hold():
    draw = np.random.default_rng(2)
    for dim in (1, 7, 64, 100):
        x, q = draw.normal(0, 50, (300, dim)), draw.normal(0, 50, (9, dim))
        x[0], q[0] = 0, 0
        low, high = negatives.intervals(q, *negatives.codes(x))
        s = q @ x.T
        assert (low <= s).all() and (s <= high).all()
        assert np.allclose((negatives.rotate(x) ** 2).sum(axis=1), (x * x).sum(axis=1))
    near = x[1:2] + draw.normal(0, 1, (1, 100))
    low, high = negatives.intervals(near, *negatives.codes(x))
    assert (high[0] < low[0, 1]).mean() > 0.5  # a close vector rules out most others unseen


def test_mine_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ASKED", 4)
    rows = vectors(3, 400, 20)
    assert mined(spark, rows) == mined_brute(rows, 10)


def test_mine_awkward_rows(spark):
    rows = vectors(4, 120, 6) + [(500, None, [1.0] * 6), (510, 1, None), (520, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (530, 1, [float("nan")] * 6), (540, 1, [float("inf")] + [0.0] * 5), (550, 1, [0.0] * 6), (560, 1, []),
                                 (None, 1, [2.0] * 6), (600, 1, [3.0, 4.0]), (601, 1, [3.0, 4.0]), (602, 2, [2.0, 2.0]), (700, 9, [1.0] * 6), (800, 1, [1e9] * 6), (801, 1, [1e9] * 6), (802, 2, [5e8 + 1] * 6)]
    rows += [rows[0], rows[0], (0, 2, rows[0][2])]  # copies count once, another row under the same id is one more anchor
    want = mined_brute(rows, 10)
    got = mined(spark, rows)
    assert got == want and any(w[0] == 600 for w in want)
    assert any(abs(w[4]) > 2**53 for w in want)


def test_mine_huge_and_empty(spark):
    rows = [(0, 1, [1e16, 3.0]), (1, 1, [1e16, 1.0]), (2, 2, [5e15, 1.0]), (3, 2, [4e15, 0.0])]
    limit = (1 << 63) - 1
    assert mined(spark, rows) == [(0, 1, 1, 2, limit, limit), (0, 1, 2, 3, limit, limit)]
    assert mined(spark, []) == []
