"""Similarity join of word shingles by T-occurrence search, and the groups of linked documents.

Documents with the same set of shingles are one node, named by a 64-bit fingerprint of the set. Every distinct shingle goes, packed in
arrays, to the bucket of its hash; there the inverted lists are complete. Only shingles that more than one set has return to their
document, with the length of their list: a link needs 4/5 of the larger set, and an intersection holds shared shingles alone. The first
pass also keeps a summary of the most frequent shingles. Those in more than ``HOT`` sets need no complete list, as all tasks rank them by the
length in the summary; they are dealt by document, so that no bucket grows with the commonest shingle. A document
whose shortest n - ceil(4n/5) + 1 lists hold nobody else is done. The others meet through these shortest lists, joined inside each batch of documents first: what hangs
together goes to one task, where each document merges its short lists, keeps who reaches T - L occurrences and probes the L long lists by
binary search. Candidates that are already in the document's component need no probe.

A set of candidates above ``BLOCK`` documents is tiled. Its documents are first compared with a few pivots; those that link with the best pivot are
connected and are not compared with each other, so a large group of near copies takes linear work. The rest meets everyone, block by block.
Every step covers all links; hashes of 64 bits stand for words and shingles.

Defined cases: a null or blank text has an empty set and links with nothing; with fewer words than a shingle the whole sequence is the one
shingle; repeated rows are copies; rows with a null id take part, their component is named by the smallest id that is not null.
An empty table gives an empty table; very long texts are taken whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut
from .bpe import chunks
from .graph import components, local_roots
from .memory import lean
from .words import Words, grams, mix

SHINGLE, BLOCK, BUCKET, FLUSH, PIVOTS = 5, 2_000, 3_000_000, 400_000, 8
HOT, TRACKED, SEEN = 30_000, 100_000, 200_000
PACKED = "fp binary, n binary, cnt binary, tok binary"


def needed(n: np.ndarray | int):
    """Smallest overlap of a set of n shingles with any set that it links with."""
    return (4 * n + 4) // 5


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, text after text and rising inside a text; number per text; fingerprint per text."""
    w = Words([(t or "").encode("utf-8", "surrogatepass") for t in texts], lower=True)
    s = grams(w.hash, size)
    whole = w.doc[:len(s)] == w.doc[size - 1:] if len(s) else np.zeros(0, bool)
    doc, tok = w.doc[:len(s)][whole], s[whole]
    words = np.bincount(w.doc, minlength=len(texts))
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        first = np.searchsorted(w.doc, short)
        one = np.array([grams(w.hash[a:a + words[d]], int(words[d]))[0] for d, a in zip(short, first)], np.uint64)
        doc, tok = np.r_[doc, short], np.r_[tok, mix(one + words[short].astype(np.uint64))]
    o = np.lexsort((tok, doc))
    doc, tok = doc[o], tok[o]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tok[1:] != tok[:-1])] if len(doc) else np.zeros(0, bool)
    doc, tok = doc[new], tok[new]
    n = np.bincount(doc, minlength=len(texts))
    fp = np.zeros(len(texts), np.uint64)
    if len(doc):
        some = np.flatnonzero(n)
        starts = np.searchsorted(doc, some)
        fp[some] = mix(np.add.reduceat(mix(tok ^ np.uint64(0x5851F42D4C957F2D)), starts) ^ np.bitwise_xor.reduceat(mix(tok + np.uint64(1)), starts) * np.uint64(0x2545F4914F6CDD1D) + n[some].astype(np.uint64))
    return tok, n, fp.view(np.int64)


class Frequent:
    """Misra-Gries summary of shingles: a count is short by at most 1 / ``size`` of all that was added."""

    def __init__(self, size: int = TRACKED):
        self.size, self.added, self.tok, self.n = size, 0, np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, tok: np.ndarray) -> None:
        found, n = np.unique(tok, return_counts=True)
        both, at = np.unique(np.r_[self.tok, found], return_inverse=True)
        n = np.bincount(at, weights=np.r_[self.n, n], minlength=len(both)).astype(np.int64)
        if len(both) > self.size:
            n -= np.partition(n, -self.size - 1)[-self.size - 1]
        self.added, self.tok, self.n = self.added + len(tok), both[n > 0], n[n > 0]

    def often(self) -> tuple[np.ndarray, np.ndarray]:
        keep = self.n >= max(2, self.added / self.size)
        return self.tok[keep], self.n[keep]


def _sizes(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Set size and fingerprint of every row; rows marked ``hot`` are shingles that a task saw often, with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kind = Frequent(), None
        row = lambda ids, n, fp, hot: pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(fp), pa.array(np.full(len(n), hot))], names=["doc_id", "n", "fp", "hot"])
        for batch in batches:
            texts, kind = batch.column(1).to_pylist(), batch.column(0).type
            for a, b in chunks([t or "" for t in texts]):
                tok, n, fp = shingle_sets(texts[a:b], size)
                seen.add(tok)
                yield row(batch.column(0).slice(a, b - a), n, fp, False)
        tok, n = seen.often()
        if len(tok):
            yield row(pa.nulls(len(tok), kind), n, tok.view(np.int64), True)
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)[id_col]}, n long, fp long, hot boolean")


def _hot(sets: DataFrame, total: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising shingles in more than ``least`` rows, at most ``TRACKED`` of them, and about how many rows hold each."""
    got = sets.filter("hot").groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") > max(least, total // TRACKED)).toPandas()
    tok, n = got["fp"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    o = np.argsort(tok)
    return tok[o], np.clip(n[o], 2, 2**31 - 1).astype(np.int32)


def _among(hot: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, tok), len(hot) - 1)] == tok if len(hot) else np.zeros(len(tok), bool)


def _pack(kind: str, part: np.ndarray, fp: np.ndarray, n: np.ndarray, at: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """One row per part with the arrays of its documents; ``at`` is the document of each item, ``part`` the part of each item."""
    o = np.lexsort((at, part))
    part, at = part[o], at[o]
    new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (at[1:] != at[:-1])])
    count = np.diff(np.r_[new, len(at)]).astype(np.int32)
    heads, first = np.unique(part, return_index=True)
    edge, group = np.r_[first, len(at)], np.r_[np.searchsorted(new, first), len(new)]
    docs = at[new]
    out = {kind: heads.astype(np.int32)}
    for name, values in (("fp", fp[docs]), ("n", n[docs].astype(np.int32)), ("cnt", count)):
        out[name] = [values[a:b].tobytes() for a, b in zip(group, group[1:])]
    for name, values in columns.items():
        values = values[o]
        out[name] = [values[a:b].tobytes() for a, b in zip(edge, edge[1:])]
    return pd.DataFrame(out)


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(pdf[c]), t) for c, t in (("fp", np.int64), ("n", np.int32), ("cnt", np.int32), ("tok", np.uint64)))


def _dealt(docs: DataFrame, text_col: str, size: int, buckets: int, parts: int, hot: np.ndarray) -> DataFrame:
    """All distinct shingles of all sets by bucket, hot ones by part of the documents; sets that a task meets again among the last ``SEEN`` are not sent again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        seen: set[int] = set()

        def flush():
            fp, n, tok = (np.concatenate(x) for x in zip(*held))
            held.clear()
            at = np.repeat(np.arange(len(n)), n)
            place = np.where(_among(hot, tok), np.uint64(buckets) + fp.view(np.uint64)[at] % np.uint64(parts), tok % np.uint64(buckets))
            got = _pack("p", place.astype(np.int64), fp, n, at, tok=tok)
            return pa.RecordBatch.from_pandas(got, preserve_index=False)

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks([t or "" for t in texts]):
                tok, n, fp = shingle_sets(texts[a:b], size)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.array([m > 0 and not (f in seen or seen.add(f)) for f, m in zip(fp.tolist(), n)], bool)
                if fresh.any():
                    held.append((fp[fresh], n[fresh], tok[np.repeat(fresh, n)]))
                if sum(len(h[2]) for h in held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()
    return docs.select(text_col).mapInArrow(lean(run), f"p int, {PACKED}")


def _lists(parts: int, buckets: int, hot: np.ndarray, often: np.ndarray):
    """Inverted lists of a bucket: shingles in two or more sets, with the length of their list, by part of the documents."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, n, cnt, tok = _unpack(pdf)
        _, once = np.unique(fp, return_index=True)
        first = np.zeros(len(fp), bool)
        first[once] = True
        at = np.repeat(np.arange(len(fp)), cnt)
        keep = first[at]
        at, tok = at[keep], tok[keep]
        if pdf["p"].iloc[0] >= buckets:
            return _pack("d", fp.view(np.uint64)[at] % np.uint64(parts), fp, n, at, tok=tok, df=often[np.searchsorted(hot, tok)])
        o = np.argsort(tok, kind="stable")
        at, tok = at[o], tok[o]
        begin = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        df = np.repeat(np.diff(np.r_[begin, len(tok)]), np.diff(np.r_[begin, len(tok)])).astype(np.int32)
        shared = df > 1
        if not shared.any():
            return pd.DataFrame({c: [] for c in ("d", "fp", "n", "cnt", "tok", "df")})
        at = at[shared]
        return _pack("d", fp.view(np.uint64)[at] % np.uint64(parts), fp, n, at, tok=tok[shared], df=df[shared])
    return run


def _shortest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents whose shortest lists hold others: fp, n, their shared shingles (rising) and those of the shortest lists."""
    fp, n, cnt, tok = _unpack(pdf)
    df = np.frombuffer(b"".join(pdf["df"]), np.int32)
    names, code = np.unique(fp, return_inverse=True)
    size = np.zeros(len(names), np.int64)
    size[code] = n
    at = np.repeat(code, cnt)
    shared = np.bincount(at, minlength=len(names))
    short = size - needed(size) + 1 - (size - shared)  # of the shortest lists, those that are shared
    live = np.flatnonzero((short > 0) & (shared >= needed(size)))
    o = np.lexsort((tok, df, at))
    at, tok = at[o], tok[o]
    edge = np.searchsorted(at, live), np.searchsorted(at, live, side="right")
    return pd.DataFrame({"fp": names[live], "n": size[live], "tok": [np.sort(tok[a:b]).tobytes() for a, b in zip(*edge)], "short": [tok[a:a + k].tobytes() for a, k in zip(edge[0], short[live])]})


def _joined(tok: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Component of each of n documents that hang together through equal shingles."""
    o = np.argsort(tok, kind="stable")
    at, same = at[o], np.diff(tok[o]) == 0
    return local_roots(n, at[1:][same], at[:-1][same])


def _by_list(buckets: int):
    """Short-list shingles by bucket; of the documents of a batch that hang together one stands for all, and (a, b) say so."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                fp, tok = pdf["fp"].to_numpy(), np.frombuffer(b"".join(pdf["short"]), np.uint64)
                at = np.repeat(np.arange(len(pdf)), np.fromiter(map(len, pdf["short"]), np.int64, len(pdf)) // 8)
                root = _joined(tok, at, len(pdf))
                tok, first = np.unique(tok, return_index=True)
                got = _pack("p", (tok % np.uint64(buckets)).astype(np.int64), fp, pdf["n"].to_numpy(), root[at[first]], tok=tok)
                some = root != np.arange(len(pdf))
                at_once = {"p": int(fp.view(np.uint64)[0] % np.uint64(buckets)), **dict.fromkeys(("fp", "n", "cnt", "tok"), b""), "a": fp[some].tobytes(), "b": fp[root[some]].tobytes()}
                yield pd.concat([got.assign(a=b"", b=b""), pd.DataFrame([at_once])]).astype({"p": "int32"})
    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents that hang together through the short lists of a bucket."""
    fp, _, cnt, tok = _unpack(pdf)
    names, code = np.unique(fp, return_inverse=True)
    root = _joined(tok, np.repeat(code, cnt), len(names))
    some = root != np.arange(len(names))
    a, b = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("a", "b"))
    return pd.DataFrame({"a": np.r_[a, names[some]], "b": np.r_[b, names[root[some]]]})


class Index:
    """Inverted lists of a block of sets, and the T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray):
        self.n = n
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tok = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        o = np.argsort(tok, kind="stable")  # inside a list documents rise
        self.docs = at[o]
        self.tokens, self.begin = np.unique(tok[o], return_index=True)
        self.end = np.r_[self.begin[1:], len(tok)]
        self.keys = np.repeat(np.arange(len(self.tokens)), self.end - self.begin) * max(len(sets), 1) + self.docs

    def search(self, tokens: np.ndarray, n: int, skip: np.ndarray) -> np.ndarray:
        """Documents with an overlap that links them with a set of n shingles, of which ``tokens`` are shared; none where ``skip``."""
        t = int(needed(n))
        if not len(self.tokens):
            return np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        place = place[self.tokens[place] == tokens]
        if len(place) < t:
            return np.empty(0, np.int64)
        place = place[np.argsort((self.end - self.begin)[place], kind="stable")]
        longest = int((self.end - self.begin)[place[-1]])
        long = min(t - 1, int(t / (0.05 * np.log2(longest + 1) + 1)))
        short, rest = place[:len(place) - long], place[len(place) - long:]
        # merging the sorted short lists counts how often each document occurs
        merged = np.concatenate([self.docs[a:b] for a, b in zip(self.begin[short], self.end[short])])
        merged = merged[~skip[merged]]
        found, count = np.unique(merged, return_counts=True)
        size = self.n[found]
        least = (4 * (n + size) + 8) // 9
        good = (count >= t - long) & (count + long >= least)
        found, count, least = found[good], count[good], least[good]
        if len(found) and len(rest):  # binary search for (list, document) in the long lists
            want = rest[:, None] * max(len(self.n), 1) + found
            spot = np.minimum(np.searchsorted(self.keys, want.ravel()), len(self.keys) - 1)
            count = count + (self.keys[spot] == want.ravel()).reshape(want.shape).sum(axis=0)
        return found[count >= least]


def _sets(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint64) for t in pdf["tok"]]


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links inside one task, as the component of each linked document."""
    base, ask = pdf[pdf["base"]], pdf[pdf["ask"]]
    names, code = np.unique(np.r_[base["fp"].to_numpy(), ask["fp"].to_numpy()], return_inverse=True)
    b, q = code[:len(base)], code[len(base):]
    comp = np.arange(len(names))
    index = Index(_sets(base), base["n"].to_numpy())
    for k, (tokens, n) in enumerate(zip(_sets(ask), ask["n"])):
        for j in index.search(tokens, int(n), comp[b] == comp[q[k]]):
            low, high = sorted((comp[b[j]], comp[q[k]]))
            if low != high:
                comp[comp == high] = low
    some = comp != np.arange(len(names))
    return pd.DataFrame({"a": names[some], "b": names[comp[some]]})


def _pivots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of documents with the pivots of their group, one row each."""
    base, ask = pdf[pdf["base"]], pdf[pdf["ask"]]
    index, names = Index(_sets(base), base["n"].to_numpy()), base["fp"].to_numpy()
    nothing = np.zeros(len(base), bool)
    out = [(fp, names[j]) for fp, tokens, n in zip(ask["fp"], _sets(ask), ask["n"]) for j in index.search(tokens, int(n), nothing)]
    return pd.DataFrame({"a": [x[0] for x in out], "b": [x[1] for x in out]}, dtype="int64").assign(super=pdf["super"].iloc[0])


def _links(live: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Links (a, b) that connect what is linked, from the documents of each set of candidates."""
    sizes = cut(groups.groupBy("super").agg(F.count("*").alias("members")), "sizes")
    work = live.select("fp", "n", "tok").join(groups, "fp").join(sizes, "super")
    total = sizes.filter(F.col("members") <= block).agg(F.sum("members")).first()[0] or 0
    tasks = max(1, -(-total // block))
    small = (work.filter(F.col("members") <= block).withColumn("task", F.pmod(F.xxhash64("super"), F.lit(tasks)))
             .select("task", "fp", "n", "tok", F.lit(True).alias("base"), F.lit(True).alias("ask")).groupBy("task").applyInPandas(_search, "a long, b long"))
    big = sizes.filter(F.col("members") > block)
    if big.isEmpty():
        return small
    large = cut(work.filter(F.col("members") > block).withColumn("nb", F.ceil(F.col("members") / block).cast("int")), "large")
    at = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col(n)).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = ["super", "fp", "n", "tok"]
    nth = F.row_number().over(W.partitionBy("super").orderBy(F.xxhash64(F.lit(2), "fp")))
    chosen = large.select("super", "fp", "nb").withColumn("nth", nth).filter(F.col("nth") <= PIVOTS).select("super", "fp")
    pivots = large.join(chosen, ["super", "fp"]).select(*out, F.lit(True).alias("base"), F.lit(False).alias("ask"), count("nb").alias("i"))
    everyone = large.select(*out, F.lit(False).alias("base"), F.lit(True).alias("ask"), at("nb", 1).alias("i"))
    hits = cut(pivots.unionByName(everyone).groupBy("super", "i").applyInPandas(_pivots, "a long, b long, super long"), "pivots")
    best = hits.groupBy("super", "b").agg(F.count("*").alias("n")).groupBy("super").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    core = hits.join(best, ["super", "b"]).select("super", F.col("a").alias("fp")).distinct()
    rest = large.join(core, ["super", "fp"], "left_anti")
    asked = cut(rest.groupBy("super").agg(F.ceil(F.count("*") / block).cast("int").alias("nq")), "sizes")
    tiles = (large.join(asked, "super").select(*out, F.lit(True).alias("base"), F.lit(False).alias("ask"), at("nb", 1).alias("i"), count("nq").alias("j"))
             .unionByName(rest.join(asked, "super").select(*out, F.lit(False).alias("base"), F.lit(True).alias("ask"), count("nb").alias("i"), at("nq", 3).alias("j"))))
    return small.unionByName(hits.select("a", "b")).unionByName(tiles.groupBy("super", "i", "j").applyInPandas(_search, "a long, b long"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, block: int = BLOCK, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; two texts link when 5 * overlap >= 4 * union of their shingles."""
    sets = cut(_sizes(docs, id_col, text_col, shingle), "sets")
    rows = sets.filter("NOT hot").drop("hot")
    total, n_rows = rows.agg(F.sum("n"), F.count("*")).first()
    buckets = buckets or max(1, -(-(total or 0) // BUCKET))
    parts = max(1, -(-n_rows // 20_000), -(-(total or 0) // BUCKET))  # neither many documents nor long ones make a large part
    tokens, often = _hot(sets, total or 0, hot)
    lists = _dealt(docs, text_col, shingle, buckets, parts, tokens).groupBy("p").applyInPandas(_lists(parts, buckets, tokens, often), f"d int, {PACKED}, df binary")
    live = cut(lists.groupBy("d").applyInPandas(_shortest, "fp long, n long, tok binary, short binary"), "live")
    met = live.select("fp", "n", "short").mapInPandas(_by_list(buckets), f"p int, {PACKED}, a binary, b binary").groupBy("p").applyInPandas(_meet, "a long, b long")
    groups = components(met).select(F.col("node").alias("fp"), F.col("component").alias("super"))
    found = components(cut(_links(live, groups, block), "linked")).select(F.col("node").alias("fp"), F.col("component").alias("comp"))
    # copies and members meet only in partial minima; the joins have plain tables on both sides, whose large keys AQE splits
    classes = cut(rows.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least")).join(found, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "classes")
    least = cut(classes.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    names = cut(classes.join(least, "comp").select("fp", "component_id"), "names")
    got = rows.withColumn("fp", F.when(F.col("n") > 0, F.col("fp"))).join(names, "fp", "left")
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
