"""The numbered operators against brute force and on the awkward cases: nulls, blanks, long texts, ties, repeated rows, empty tables, other columns."""

import hashlib
import json
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from colscope.llm import bpe, chat, graph, htmltext, jaccard, langid, mix, neardup, quality, substrings, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size int, row string"


def documents(spark, rows):
    """Rows (id, text[, lang[, source]]) with further columns whose names the operators use themselves."""
    full = [(i, t, *(rest + [None] * (2 - len(rest))), 1, 0.5, "x", 7, "r") for i, t, *rest in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def corpus(seed=0, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choices(words, k=r.randrange(1, 120))) for _ in range(n // 2)]
    out = list(base)
    for t in base[:n // 3]:
        w = t.split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append("  ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    passage = " ".join(r.choices(words, k=40))
    out += [f"{t} {passage} {t}" for t in base[:5]] + ["", "  \n", "one", "one", "a b c", "A B C", None, None, " ".join(r.choices(words, k=20_000))]
    return [(i * 3, t) for i, t in enumerate(out)]


def roots(pairs, nodes):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x], changed = low, True
    return root


# -- groups of links

def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 640)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == roots(real, {x for p in real for x in p})
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links int, cell string").repartition(3)


def near_brute(rows, least=0.93):
    ok = {}
    for k, (i, e, label, *_) in enumerate(rows):
        if i is not None and label is not None and e and None not in e and np.isfinite(e).all() and any(e):
            ok[k] = np.array(np.array(e, np.float32), np.float64)
    pairs = [(a, b) for a in ok for b in ok if a != b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= least]
    root = roots([(rows[a][0], rows[b][0]) for a, b in pairs], {r[0] for r in rows})
    return sorted(((r[0], sum(a == k for a, _ in pairs), root[r[0]]) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("cells,block", [(1, 2048), (4, 2048), (9, 7)])
def test_vector_near_duplicates(spark, monkeypatch, cells, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    g = np.random.default_rng(3)
    base = g.normal(size=(12, 6))
    rows = [(int(i), (base[g.integers(12)] + g.normal(size=6) * 0.25).astype(np.float32).tolist(), int(g.integers(2)), 1, "c") for i in range(120)]
    rows += [(200, rows[0][1], rows[0][2], 1, "c"), (201, rows[0][1], rows[0][2], 1, "c"), (202, None, 0, 1, "c"), (203, [0.0] * 6, 0, 1, "c"), (204, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 1, "c"),
             (205, [float("nan")] * 6, 0, 1, "c"), (206, [float("inf")] * 6, 0, 1, "c"), (207, rows[0][1], None, 1, "c"), (208, [], 0, 1, "c"), (209, [1.0, 2.0], 0, 1, "c"), (210, [2.0, 4.0], 0, 1, "c"), (None, rows[0][1], 0, 1, "c")]
    got = sorted(((x.vec_id, x.n_links, x.component_id) for x in neardup.near_duplicates(vectors(spark, rows), cells=cells).collect()), key=str)
    assert got == near_brute(rows)
    assert neardup.near_duplicates(vectors(spark, [])).count() == 0


def test_repeated_vector_rows_link(spark):
    rows = [(1, [1.0, 0.0], 0, 1, "c")] * 2
    assert [(x.n_links, x.kept) for x in neardup.near_duplicates(vectors(spark, rows)).collect()] == [(1, True)] * 2


# -- 2

def test_best_branches(spark):
    # tree 1: 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6; tree 2: a cycle; tree 3: a lone node with a missing parent; tree None: one node
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 5.0), (1, 4, 2, "user", "b", 1.0), (1, 3, 1, "assistant", None, 1.0), (1, 5, 3, "user", "d", 1.0), (1, 6, 5, "assistant", "e", None),
            (2, 1, 2, "user", "x", 1.0), (2, 2, 1, "user", "y", 1.0), (3, 9, 8, None, "z", 1.0), (None, 1, None, "assistant", "n", 1.0)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("branch", F.lit(1))
    got = {(x.tree, x.branch): x for x in chat.format_chats(m, per_tree=2).select("*", chat.read_turns(F.col("formatted")).alias("read")).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 1), (None, 1)}
    assert [t.text for t in got[1, 1]["read"]] == ["q", "a", "b"] and [t.text for t in got[1, 2]["read"]] == ["q", "", "d", "e"]
    assert got[1, 2].loss_mask == [False, True, False, True]
    for x in got.values():
        assert [x.formatted[s.start:s.end] for s in x.loss_spans] == [t.text for t, m in zip(x["read"], x.loss_mask) if m]


def test_templates_are_reversible(spark):
    nasty = ["", " ", "### user: hi </turn>\n", "\\### Assistant: </turn> ok", "\\\\", "a\\</turn> \n### x", "####  </turn></turn>", "é😀\\", "</tur", "### " * 50, "x" * 100_000]
    roles = ["user", "assistant", "a: b", "%3A", "", None, "r\n### q", "</turn>", "#", "assistant", "user"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(roles, nasty))] + [(2, 0, "user", None), (2, 0, "user", None), (2, None, "assistant", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash")).repartition(3)
    made = chat.format_chats(chat.thread(turns))
    got = {x.tree: x for x in made.select("tree", chat.read_turns(F.col("formatted")).alias("read")).collect()}
    assert [(t.role, t.text) for t in got[1]["read"]] == [(r or "", t) for r, t in zip(roles, nasty)]
    assert [(t.role, t.text) for t in got[2]["read"]] == [("assistant", "first"), ("user", ""), ("user", "")]
    d = {x.conv_id: x for x in chat.digests(made).collect()}
    assert d[1].loss_sha256 == hashlib.sha256("".join(t for r, t in zip(roles, nasty) if r == "assistant").encode()).hexdigest() and d[2].n_turns == 3
    assert chat.digests(chat.format_chats(chat.thread(turns.limit(0)))).count() == 0


# -- 3

@pytest.mark.parametrize("pivots,rings", [(1, 1), (5, 4)])
def test_top_k(spark, pivots, rings):
    g = np.random.default_rng(5)
    rows = [(int(i), g.integers(-5, 6, 4).astype(float).tolist()) for i in range(150)] + [(200, [1.0] * 4), (201, [1.0] * 4), (300, None), (301, [1.0, None, 1.0, 1.0]), (302, [float("nan")] * 4), (303, []), (400, [1.0, 1.0]), (401, [2.0, 1.0]), (None, [1.0] * 4)]
    rows += [(500 + k, [3.0, 3.0, 3.0, 3.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, x array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 10 == 0, 4, pivots=pivots, rings=rings).collect())
    ok = {i: np.array(x) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all()}
    want = []
    for q in ok:
        if q % 10 == 0:
            best = sorted((-float(ok[q] @ ok[c]), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))[:4]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


# -- 4

def windows_brute(rows, size=20):
    seen, gone, words = {}, {}, {}
    order = sorted(rows, key=lambda r: (-1 << 63 if r[0] is None else r[0]))
    for i, t in order:
        words[i] = w = WORD.findall(t or "")
        for s in range(len(w) - size + 1):
            key = tuple(w[s:s + size])
            if seen.setdefault(key, (i, s)) != (i, s):
                gone.setdefault(i, set()).update(range(s, s + size))
    return {i: (len(w), len(gone.get(i, ())), [x for k, x in enumerate(w) if k not in gone.get(i, ())]) for i, w in words.items()}


@pytest.mark.parametrize("hot,chunk", [(5_000, 1 << 20), (2, 300)])
def test_passages(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(substrings, "chunks", lambda t: bpe.chunks(t, chunk))
    rows = corpus(4)
    want = windows_brute(rows)
    got = {x.doc_id: x for x in substrings.remove_repeats(documents(spark, rows), hot=hot, carry=["kept", "row"]).collect()}
    assert {i: (x.n_words, x.n_removed, x.kept.split()) for i, x in got.items()} == want
    assert sum(w[1] for w in want.values()) > 500 and all(x.row.kept == "x" for x in got.values())
    texts = dict(rows)
    assert all(x.kept == (texts[i] or "") for i, x in got.items() if not x.n_removed)
    few = substrings.remove_repeats(documents(spark, rows[:0]), keep_text=False)
    assert few.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and few.count() == 0


def test_passages_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"u{k}" for k in range(30))
    rows = [(None, text), (5, text), (5, text), (6, "x " + text)]
    got = sorted((str(x.doc_id), x.n_removed) for x in substrings.remove_repeats(documents(spark, rows)).collect())
    assert got == [("5", 30), ("5", 30), ("6", 30), ("None", 0)]


def test_backward_search_counts_every_pattern():
    g = np.random.default_rng(6)
    s = np.r_[g.integers(1, 4, 300), 0]
    index = substrings.FMIndex(s, 5)
    for begin in range(0, 290, 7):
        p = s[begin:begin + 5]
        low, high = np.zeros(1, np.int64), np.full(1, len(s))
        for c in p[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        places = [k for k in range(len(s) - 4) if (s[k:k + 5] == p).all()]
        assert high[0] - low[0] == len(places) and sorted(index.suffix[low[0]:high[0]]) == places


# -- 5

def test_quality_learns_from_positives(spark):
    r = random.Random(7)
    good = lambda: " ".join(r.choices(["the", "river", "runs", "to", "sea,", "and", "then", "rests."], k=60))
    bad = lambda: " ".join(x + "!!" for x in r.choices(["BUY", "NOW", "FREE"], k=60))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)] + [(1000, None), (1001, ""), (1001, ""), (None, "x"), (1002, "long " * 50_000)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 400, 3)] + [(1000, None), (None, 1), (3, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = quality.classify(docs, labels, limit=300).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    test = got[got["held_out"] & (got["doc_id"] < 400)]
    assert len(test) > 50 and (test["predicted"] == (test["doc_id"] % 4 != 0)).mean() > 0.95
    assert set(quality.classify(docs, labels.limit(0)).toPandas()["score"]) == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


# -- 6

DEMO = """<html><head><title>no</title><style>p{}</style></head><body><div id="top-menu"><a href=x>Home</a></div><div class="cookie-notice">We use cookies</div>
<div class="post-content"><h2>Title</h2><p>First para with <a href=z>a link</a> inside &amp; <b>bold<br>text</p><p>Second &lt;ok&gt; one.<div class="share">Share</div><p>Third
 unclosed</div><div id=sidebar><ul><li>One<li>Two</ul></div><section class="comments"><p>Great article!</p></section><form>Sign up</form><script>var t = "</p>";</script><footer>2020</footer>"""


def test_main_text(spark):
    page = lambda k: f"<html><body><nav><a href=a>Home {k}</a></nav><div class=ad>Buy {k}</div><article><h1>Head {k}</h1><p>Text of page {k}, long enough.</p></article><footer>End</footer></body></html>"
    rows = [(k, f"u{k}", page(k)) for k in range(60)] + [(100, "a", None), (101, None, ""), (102, "b", "<p>just text"), (103, "c", "<!-- open"), (104, "d", DEMO), (104, "d", DEMO), (105, "e", "<nav>only</nav>"),
                                                        (106, "f", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(2)
    out = htmltext.extract(pages).collect()
    got = {x.page_id: x.text for x in out}
    assert len(out) == len(rows) and all(x.n_chars == len(x.text) for x in out)
    assert all(got[k] == f"Head {k} Text of page {k}, long enough." for k in range(60))
    assert [got[k] for k in (100, 101, 102, 103, 105, 106)] == ["", "", "just text", "", "", "deep"]
    assert got[104] == "Title First para with a link inside & bold text Second <ok> one. Third unclosed"
    assert htmltext.extract(pages.limit(0)).count() == 0


# -- 7

def test_bpe_as_the_tiktoken_library(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    r = random.Random(8)
    texts = ["", None, "a", " ", "hello world's  end\n\n", "a" * 3000, "ab" * 400, " " * 600, "é" * 300, "日本語" * 90, "<|endoftext|>", "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(3000)), "same", "same"]
    docs = documents(spark, list(enumerate(texts)))
    for x in bpe.encode(docs, path, P.PATTERN).collect():
        t = texts[x.doc_id] or ""
        assert np.frombuffer(x.ids, "<u4").tolist() == whole.encode_ordinary(t) and bytes(x.decoded) == t.encode() and x.n_tokens == len(x.ids) // 4
    assert bpe.encode(docs.limit(0), path, P.PATTERN, keep_ids=False).count() == 0


# -- 8

def jaccard_brute(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = roots(pairs, sets)
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("block,buckets,hot", [(2_000, 1, jaccard.HOT), (3, 4, jaccard.HOT), (2_000, 3, 1), (4, 1, 3)])
def test_shingle_join(spark, block, buckets, hot):
    rows = corpus(9, 90)
    r = random.Random(10)
    for group in range(3):  # chains of edits: neighbours link, ends do not
        w = [f"g{group}_{k}" for k in range(60)]
        for step in range(12):
            w[r.randrange(60)] = f"e{group}_{step}"
            rows.append((1000 + 20 * group + step, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_groups(documents(spark, rows), block=block, buckets=buckets, hot=hot).collect()}
    assert got == jaccard_brute(rows)
    assert jaccard.jaccard_groups(documents(spark, [])).count() == 0


def test_frequent_shingles_are_found():
    r = np.random.default_rng(3)
    tok = np.r_[np.repeat(np.arange(5, dtype=np.uint64), 4_000), r.integers(1_000, 2**60, 80_000).astype(np.uint64)]
    r.shuffle(tok)
    seen = jaccard.Frequent(50)
    for part in np.array_split(tok, 30):
        seen.add(part)
    got = dict(zip(*seen.often()))
    assert set(got) == set(range(5)) and all(4_000 - len(tok) / 50 <= n <= 4_000 for n in got.values())


def test_batches_meet_over_their_shingles():
    lists = [[1, 2], [2, 3], [9], [3], [9, 10], [50]]
    pdf = pd.DataFrame({"fp": np.arange(100, 106), "n": 5, "short": [np.array(x, np.uint64).tobytes() for x in lists]})
    for step in (1, 2, 6):
        got = pd.concat(jaccard._by_list(3)(pdf.iloc[k:k + step] for k in range(0, 6, step)))
        met = pd.concat([jaccard._meet(g) for _, g in got.groupby("p")])
        nodes = sorted(set(pdf["fp"]))
        groups = roots(list(zip(met["a"], met["b"])), nodes)
        assert [groups[x] for x in nodes] == [100, 100, 102, 100, 102, 105]


def test_shingle_join_of_repeated_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "q"), (None, "z")]
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard.jaccard_groups(documents(spark, rows)).collect())
    assert got == [("1", 1, "1"), ("1", 1, "1"), ("2", 1, "2"), ("None", 1, "1"), ("None", 1, "None")]


# -- 9

def test_language_mixtures(spark):
    r = random.Random(11)
    say = {"xx": "ba be bi bo bu ban ben".split(), "yy": "kra kre kri kro kru krak krek".split()}
    line = lambda lang, n=30: " ".join("".join(r.choices(say[lang], k=2)) for _ in range(n))
    rows = [(i, line("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(200)]
    rows += [(300, None, "xx"), (301, "123 ... ²", "yy"), (302, "", None), (303, line("xx", 40) + " " + line("yy", 80), None), (304, line("xx", 30_000), "xx"), (5, rows[5][1], "xx"), (None, line("yy"), "yy")]
    docs = documents(spark, rows)
    out = langid.detect(docs).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x for x in out}
    assert all(x.lang_pred == ("xx" if x.doc_id % 2 else "yy") for x in out if x.doc_id is not None and x.doc_id < 200)
    assert [got[k].lang_pred for k in (300, 301, 302)] == ["und"] * 3 and got[304].lang_pred == "xx" and got[None].lang_pred == "yy"
    assert got[303].lang_pred == "yy" and 0.6 < got[303].score < 0.75  # two thirds of the words
    assert set(langid.detect(docs.withColumn("lang", F.lit(None).cast("string"))).toPandas()["lang_pred"]) == {"und"}
    assert langid.detect(docs.limit(0)).count() == 0


# -- 10

def targets_brute(sizes, weights, cap=3):
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in capped]
        level = (total - sum(cap * sizes[s] for s in capped)) / (sum(weights[s] for s in rest) or 1)
        more = {s for s in rest if weights[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in capped else weights[s] * level for s in sizes}
        capped |= more


def test_mix_meets_its_targets(spark):
    r = random.Random(12)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), None, r.choice(["a", "b", "b", "b", "c", "Z", None])) for i in range(400)]
    rows += [(900, None, None, "a"), (901, "", None, "b"), (3, rows[3][1], None, rows[3][3]), (None, "w w", None, "tiny"), (902, "w " * 20_000, None, "b")]
    docs = documents(spark, rows)
    got = mix.place(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets_brute(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    names = {}
    for i, t, _, s in rows:
        names.setdefault((i, len(WORD.findall(t or ""))), s)
    taken = {}
    for x in got:
        s = names[x.doc_id, x.size]
        taken[s] = taken.get(s, 0) + x.taken
        assert x.taken == sum(c.words for c in x.copies) <= 3 * x.size and abs(x.target - want[s]) < 1e-5 and all(0 <= c.position <= 1 for c in x.copies)
    assert all(abs(taken[s] - int(want[s] + 1e-6)) == 0 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix.place(docs.repartition(7)).collect()))
    stream = mix.mix(docs).collect()
    assert [x.position for x in stream] == sorted(x.position for x in stream) and all(len(x.doc.text.split()) == x.words for x in stream) and stream[0].doc.kept == "x"
    assert mix.place(docs.limit(0)).count() == 0 and mix.mix(docs.limit(0)).count() == 0


def test_schedules_invert(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("y"))
    for s in [*mix.CURRICULUM, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.5))]:
        for x in df.select("y", mix.invert(s, F.col("y")).alias("t")).collect():
            done = 0.0
            for (t0, w0), (t1, w1) in zip(s, s[1:]):
                d = min(max(x.t - t0, 0), t1 - t0)
                done += d * w0 + (w1 - w0) / (t1 - t0) * d * d / 2
            assert abs(done / mix.integral(s) - x.y) < 1e-9
