"""Removal of passages seen before: windows of words that also start earlier, found with an FM-index per shard.

Windows meet in shards by content. The minimiser of a window is the smallest hash of its runs of ``GRAM`` words; equal windows have equal
minimisers, and neighbouring windows mostly share theirs. Pass one sends the minimisers, once per task, to find those that occur again;
only stretches of windows with such a minimiser are sent on, to the shard of the minimiser. A shard holds each distinct stretch
once, in order of its first occurrence, as a sequence of word numbers: suffixes are sorted, the Burrows-Wheeler transform goes into a
wavelet matrix of bit vectors with sampled ranks, and all stretches are streamed through it together by backward search. Their matching
statistics, cut at the window's length, give for each window the interval of its occurrences, whose smallest position tells if it starts earlier.

Equal stretches of a task are merged before the shuffle: all but the first are copies. A minimiser with more than ``HOT`` stretches is taken
out of the shards and its windows are compared one by one after a hash shuffle, so a phrase that a third of all documents hold makes
no large shard. Every window is judged on the input; no length, count or text is capped.

Defined cases: a null text has no words; a null id counts as the smallest id; documents shorter than a window lose nothing; rows with
the same id and text are one document and get equal rows; other columns are not read. Ids are integers. An empty table gives an empty table.
Hashes only choose what is compared: shards compare words, and hot windows 128-bit digests of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .bpe import chunks
from .memory import lean
from .words import Words, grams

WINDOW, GRAM = 20, 6
HOT, STRETCHES, FLUSH, BUCKET_CHARS = 5_000, 8_000, 500_000, 100_000_000
LOWEST = -(1 << 63)


def stretches(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser hash of each stretch of windows with one minimiser; windows are numbered by their first word."""
    g = grams(w.hash, gram)
    wide = window - gram + 1
    if len(g) < wide:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    m = np.lib.stride_tricks.sliding_window_view(g, wide).argmin(axis=1) + np.arange(len(g) - wide + 1)
    inside = np.flatnonzero(w.doc[:len(m)] == w.doc[window - 1:window - 1 + len(m)])
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    m = m[inside]
    new = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (inside[1:] != inside[:-1] + 1)])
    return inside[new], np.diff(np.r_[new, len(m)]), g[m[new]]


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _minimisers(window: int, gram: int, buckets: int):
    """Each task's minimisers once per bucket (twice where the task met them again), and for each document those met again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush():
            doc, tok = (np.concatenate(x) for x in zip(*held))
            held.clear()
            o = np.argsort(tok, kind="stable")
            doc, tok = doc[o], tok[o]
            begin = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            times = np.diff(np.r_[begin, len(tok)])
            again = np.repeat(times > 1, times)
            seen = pd.DataFrame({"doc": doc[again], "tok": tok[again]}).sort_values("doc", kind="stable")
            names, first = np.unique(seen["doc"].to_numpy(), return_index=True)
            flat, ends = seen["tok"].to_numpy(), np.r_[first[1:], len(seen)]
            local = pd.DataFrame({"p": -1, "id": names, "doc": b"", "tok": [flat[a:b].tobytes() for a, b in zip(first, ends)]})
            doc, tok = np.repeat(doc[begin], np.minimum(times, 2)), np.repeat(tok[begin], np.minimum(times, 2))
            part = (tok % np.uint64(buckets)).astype(np.int64)
            o = np.lexsort((doc, part))
            doc, tok, part = doc[o], tok[o], part[o]
            heads, first = np.unique(part, return_index=True)
            edge = np.r_[first, len(part)]
            sent = pd.DataFrame({"p": heads, "id": 0, "doc": [doc[a:b].tobytes() for a, b in zip(edge, edge[1:])], "tok": [tok[a:b].tobytes() for a, b in zip(edge, edge[1:])]})
            return pa.RecordBatch.from_pandas(pd.concat([local, sent]).astype({"p": "int32"}), schema=pa.schema([("p", pa.int32()), ("id", pa.int64()), ("doc", pa.binary()), ("tok", pa.binary())]), preserve_index=False)

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in chunks([t or "" for t in texts]):
                w = Words(_bytes(texts[a:b]))
                at, _, tok = stretches(w, window, gram)
                held.append((ids[a:b][w.doc[at]], tok))
            if sum(len(h[1]) for h in held) >= FLUSH:
                yield flush()
        if sum(len(h[1]) for h in held):
            yield flush()
    return run


def _again(pdf: pd.DataFrame) -> pd.DataFrame:
    """Minimisers of a bucket that occur again, by document."""
    doc, tok = np.frombuffer(b"".join(pdf["doc"]), np.int64), np.frombuffer(b"".join(pdf["tok"]), np.uint64)
    o = np.argsort(tok, kind="stable")
    doc, tok = doc[o], tok[o]
    begin = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    times = np.diff(np.r_[begin, len(tok)])
    again = np.repeat(times > 1, times)
    doc, tok = doc[again], tok[again]
    o = np.argsort(doc, kind="stable")
    doc, tok = doc[o], tok[o]
    names, first = np.unique(doc, return_index=True)
    return pd.DataFrame({"doc": names, "tok": [tok[a:b].tobytes() for a, b in zip(first, np.r_[first[1:], len(tok)])]})


def _merged(found: Iterator[tuple[bytes, tuple[int, int, int, int, int], bytes | None]]) -> Iterator[pd.DataFrame]:
    """Keeps the first (doc, start) of equal contents; what comes after it is a copy, sent without content."""
    kept: dict[bytes, tuple] = {}
    gone: list = []
    for key, row, content in found:
        old = kept.get(key)
        if old is None:
            kept[key] = (*row, content)
        elif row[1:4:2] < old[1:4:2]:
            gone.append((*old[:-1], None))
            kept[key] = (*row, old[-1])
        elif row[1:4:2] > old[1:4:2]:
            gone.append((*row, None))
        if len(gone) >= 50_000:
            yield pd.DataFrame(gone, columns=COLUMNS)
            gone = []
    rows = gone + list(kept.values())
    for i in range(0, len(rows), 50_000):
        yield pd.DataFrame(rows[i:i + 50_000], columns=COLUMNS)


COLUMNS = ["key", "doc", "tid", "start", "n", "content"]
SCHEMA = "key long, doc long, tid long, start int, n int, content binary"


def _candidates(window: int, gram: int):
    """Stretches whose minimiser occurs again, with their words."""
    def found(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in chunks(texts):
                w = Words(_bytes(texts[a:b]))
                at, n, tok = stretches(w, window, gram)
                head = np.searchsorted(w.doc, np.arange(b - a))
                where = np.searchsorted(w.doc[at], np.arange(b - a + 1))
                for k, (doc, tid, again) in enumerate(zip(pdf["doc"].iloc[a:b], pdf["tid"].iloc[a:b], pdf["again"].iloc[a:b])):
                    i, j = where[k], where[k + 1]
                    for r in (np.flatnonzero(np.isin(tok[i:j], np.frombuffer(b"".join(again), np.uint64))) + i).tolist():
                        first, last = at[r], at[r] + n[r] + window - 2
                        content = b" ".join(w.raw[w.start[first]:w.end[last]].split())
                        yield hashlib.blake2b(content, digest_size=16).digest(), (int(tok[r].view(np.int64)), doc, tid, int(first - head[k]), int(n[r])), content

    return lambda batches: _merged(found(batches))


def _windows(window: int):
    """Single windows of stretches, with the hash of their words as key; only the first of each task needs to be compared."""
    def found(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for doc, tid, start, content in zip(pdf["doc"], pdf["tid"], pdf["start"], pdf["content"]):
                words = content.split()
                for k in range(len(words) - window + 1):
                    key = hashlib.blake2b(b" ".join(words[k:k + window]), digest_size=16).digest()
                    yield key, (0, doc, tid, start + k, 1), key

    return lambda batches: _merged(found(batches))


class FMIndex:
    """Suffixes of a sequence sorted to at least ``depth`` symbols, its Burrows-Wheeler transform in a wavelet matrix, backward search for many patterns at once."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.n, rank, step, ranks = n, symbols.astype(np.int64), 1, {1: symbols.astype(np.int64)}
        order = np.argsort(rank, kind="stable")
        while step <= depth:
            nxt = np.zeros(n, np.int64)
            nxt[:max(n - step, 0)] = rank[step:] + 1
            key = rank * (int(nxt.max(initial=0)) + 1) + nxt
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
            step *= 2
            ranks[step] = rank
        self.suffix = order
        bwt = symbols[order - 1]  # the sequence is taken as a circle
        # suffixes with the same first ``depth`` symbols stand together
        new, offset = np.zeros(n, bool), 0
        new[:1] = True
        for bit in range(depth.bit_length() - 1, -1, -1):
            if depth >> bit & 1:
                at = order + offset
                r = np.where(at < n, ranks[1 << bit][np.minimum(at, n - 1)], -1)
                new[1:] |= r[1:] != r[:-1]
                offset += 1 << bit
        self.group = np.cumsum(new) - 1
        self.begin = np.flatnonzero(new)
        self.end = np.r_[self.begin[1:], n]
        self.first = np.minimum.reduceat(order, self.begin)
        sigma = int(symbols.max()) + 1
        self.bits = max(1, (sigma - 1).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            ones = (bwt >> b & 1).astype(bool)
            packed = np.packbits(np.r_[ones, np.zeros(64 - n % 64, bool)], bitorder="little").view("<u8")
            sampled = np.r_[0, np.cumsum(np.bitwise_count(packed).astype(np.int64))]
            self.levels.append((b, packed, sampled, n - int(ones.sum())))
            bwt = np.r_[bwt[~ones], bwt[ones]]
        every = np.arange(sigma)
        before = np.r_[0, np.cumsum(np.bincount(symbols, minlength=sigma))][:-1]
        self.shift = before - self._down(every, np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, packed, sampled, zeros in self.levels:
            word = at >> 6
            ones = sampled[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> b & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both = self._down(np.r_[symbol, symbol], np.r_[low, high]) + np.r_[self.shift[symbol], self.shift[symbol]]
        return both[:len(low)], both[len(low):]


def repeated_windows(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """True at each position where a window of the streamed stretches starts that also starts earlier in the sequence."""
    index = FMIndex(symbols, window)
    out = np.zeros(len(symbols), bool)
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), index.n, np.int64)
    o = np.argsort(-size, kind="stable")
    begin, size = begin[o], size[o]
    for step in range(1, int(size.max(initial=0)) + 1):
        m = int(np.searchsorted(-size, -step, side="right"))  # stretches that are long enough
        at = begin[:m] + size[:m] - step
        lo, hi = index.extend(symbols[at], low[:m], high[:m])
        if step >= window:  # the match is cut to the window's length: its interval widens to all suffixes that agree so far
            group = index.group[lo]
            lo, hi = index.begin[group], index.end[group]
            out[at] = index.first[group] < at
        low[:m], high[:m] = lo, hi
    return out


def _shard(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "start"], kind="stable")
        # copies of a stretch beyond the first are removed whole
        copy = pdf["content"].duplicated().to_numpy()
        doc, tid, start, n = (pdf[c].to_numpy() for c in ("doc", "tid", "start", "n"))
        # the same place can come twice where rows with one id and text were in different tasks
        first = pd.Series(np.arange(len(pdf))).groupby(pdf["content"].to_numpy()).transform("first").to_numpy()
        same = copy & (doc == doc[first]) & (start == start[first])
        one = ~copy
        rows = [c.split() for c in pdf["content"][one]]
        numbers: dict[bytes, int] = {}  # the alphabet: words themselves, not their hashes
        code = np.array([numbers.setdefault(x, len(numbers)) for row in rows for x in row], np.int64)
        m = len(rows)
        size = np.fromiter(map(len, rows), np.int64, m)
        begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        symbols = np.zeros(int(size.sum()) + m, np.int64)  # 0 ends a stretch
        symbols[np.arange(len(code)) + np.repeat(np.arange(m), size)] = code + 1
        hit = repeated_windows(symbols, begin, size, window)
        at = np.flatnonzero(hit)
        of = np.searchsorted(begin, at, side="right") - 1
        place = np.flatnonzero(one)[of]
        found = pd.DataFrame({"doc": doc[place], "tid": tid[place], "start": start[place] + at - begin[of], "n": 1})
        gone = copy & ~same
        copies = pd.DataFrame({"doc": doc[gone], "tid": tid[gone], "start": start[gone], "n": n[gone]})
        return pd.concat([copies, found])
    return run


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc, tid, start, n): runs of windows that also start earlier. ``docs`` has doc, tid and text."""
    rows, chars = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    buckets = max(1, -(-(chars or 0) // BUCKET_CHARS))
    sent = cut(docs.select("doc", "text").mapInArrow(lean(_minimisers(window, gram, buckets)), "p int, id long, doc binary, tok binary"), "minimisers")
    far = sent.filter("p >= 0").groupBy("p").applyInPandas(_again, "doc long, tok binary")
    near = sent.filter("p < 0").select(F.col("id").alias("doc"), "tok")
    again = far.unionByName(near).groupBy("doc").agg(F.collect_list("tok").alias("again"))
    found = cut(docs.join(again, "doc").select("doc", "tid", "text", "again").mapInPandas(lean(_candidates(window, gram)), SCHEMA), "stretches")
    place = ["doc", "tid", "start", "n"]
    ask = found.filter("content IS NOT NULL")
    crowded = cut(ask.groupBy("key").count().filter(F.col("count") > hot).select("key"), "crowded")
    shards = max(1, -(-ask.count() // STRETCHES))
    by_index = (ask.join(crowded, "key", "left_anti").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard")
                .applyInPandas(_shard(window), "doc long, tid long, start int, n int"))
    single = cut(ask.join(crowded, "key", "left_semi").mapInPandas(lean(_windows(window)), SCHEMA), "windows")
    least = single.filter("content IS NOT NULL").groupBy("content").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = single.filter("content IS NOT NULL").join(least, "content").filter(F.struct("doc", "start") > F.col("first"))
    return (found.filter("content IS NULL").select(place).unionByName(by_index).unionByName(single.filter("content IS NULL").select(place)).unionByName(later.select(place)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, keep_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and what stays: the text ``kept``, unchanged where nothing goes, else the words that stay with one space between.

    Without ``keep_text`` it is kept_sha256 of those words. The columns that ``carry`` names come along as the struct ``row``.
    """
    whole = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), F.xxhash64(text_col).alias("tid"), F.coalesce(text_col, F.lit("")).alias("text"),
                        *[F.struct(*map(F.col, carry)).alias("row") for _ in range(bool(carry))])
    spots = repeated(whole.select("doc", "tid", "text"), window, gram, hot).groupBy("doc", "tid").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    name = "kept" if keep_text else "kept_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ns in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ns"))):
                words = text.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, np.int64)
                if starts:
                    first, n = np.array(starts), np.array(ns)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n + window - 1, -1)
                stay = np.cumsum(edge)[:-1] == 0
                gone = len(words) - int(stay.sum())
                kept = b" ".join([w for w, s in zip(words, stay.tolist()) if s] if gone else words)
                out.append((len(words), gone, (kept.decode("utf-8", "surrogatepass") if gone else text) if keep_text else hashlib.sha256(kept).hexdigest()))
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), *([batch.column("row")] if carry else [])],
                                             names=["doc_id", "n_words", "n_removed", name, *(["row"] if carry else [])])

    joined = whole.join(spots, ["doc", "tid"], "left").select("doc", "text", "starts", "ns", *(["row"] if carry else []))
    schema = joined.select(F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias(name), *(["row"] if carry else [])).schema
    got = joined.mapInArrow(lean(run), schema)
    return got.withColumn("doc_id", F.when(F.col("doc_id") != LOWEST, F.col("doc_id")))
