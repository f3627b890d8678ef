"""Alignment of two tokenizers over the bytes they share, and how usual each aligned pair is in the corpus.

Both id lists of a text get a dictionary from cumulative byte end to index. The sorted intersection of the keys slices both lists into
groups; within the slices every byte range between neighbouring ends of either list links the two tokens that cover it. Stretches between single spaces end on
both sides, so a task aligns those it has not met yet together, in arrays, and puts texts together from what it knows; where a tokenizer does not allow that cut, or
a stretch does not give back its bytes, the whole text is aligned at once.

Three passes: tokens, groups and distinct pairs of every document, written as packed arrays; the documents that hold a pair, counted in each task
before the shuffle; sums over every document's links. For the sums, pairs held by the most documents travel to the tasks, at most ``BOUND`` of them; links
of rarer ones, where there are more, are joined by shuffle, and as they are rare none of their keys is hot.

Defined cases: null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: zeros and an empty digest. Repeated rows and
rows with equal or null ids are documents of their own and are counted as such. A text is aligned whole, in memory that follows its own tokens.
Empty tables give no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .bpe import chunks
from .memory import lean
from .stretches import FROM_CHAR, SINGLE_SPACE, by_ranks, byte_level, cuts_at_spaces, segments

BOUND, FLUSH = 1 << 20, 1 << 20
KEPT, LONGEST = 200_000, 48  # stretches that a task remembers, and their characters at most
SHORT = 128  # characters of a segment for the pieces, whose merging slows down with length
MARK = "▁"  # stands for a space in pieces


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes behind the last token of every group in both lists, from their cumulative byte ends."""
    index_a, index_b = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1))), dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    return tuple(np.fromiter(map(index.__getitem__, common), np.int64, len(common)) for index in (index_a, index_b))


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all links and their places in both lists: one for of every pair whose byte ranges overlap; both lists cover the same bytes, so a pair shares just one range between neighbouring ends."""
    every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two rising runs
    every = every[np.append(every[1:] != every[:-1], True)]
    return every, np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)


Aligned = tuple[int, int, int, str, bytes]  # n_a, n_b, n_groups, the groups with an end mark each, keys of all links (64-bit integers)


class Aligner:
    """Aligns texts by two tokenizer files: a byte-level BPE on space + text, and a BPE over pieces that adds the space itself."""

    def __init__(self, json_a: str, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        a = Tokenizer.from_str(json_a)
        a.encode_special_tokens = True
        ranks = by_ranks(json_a, special=False)
        self.lossless = ranks is not None  # merges of the text's own bytes, nothing else
        self.encode_a = (lambda t: ranks.encode_to_numpy(t, disallowed_special=())) if ranks else (lambda t: np.array(a.encode(t, add_special_tokens=False).ids, np.int64))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        entries = [a.id_to_token(i) for i in range(a.get_vocab_size())]
        self.bytes_a = [byte_level(e) if e is not None and set(e) <= FROM_CHAR.keys() else (e or "").encode() for e in entries]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.wide = len(names)  # a pair's key is a * wide + b
        self.cuts = cuts_at_spaces(json_a) and not any(MARK in p.lstrip(MARK) for p in names)
        # how an id is written before a comma, before a bar and before a semicolon
        self.kinds = max(len(entries), len(names))
        self.known: dict[str, Aligned | None] = {}
        self.written = np.array([f"{i}{c}" for c in ",|;" for i in range(self.kinds)], object)
        self.width = np.array([len(x) for x in self.written])

    def _arrays(self, text: str) -> tuple | None:
        """Byte ends in both lists, of the groups and of the links, the groups as text with the end of every token in it, and keys of all links; None where the bytes differ."""
        whole = (" " + text).encode()
        a = self.encode_a(" " + text).astype(np.int64)
        list_b = list(chain.from_iterable(self.b.encode(segments(text, SHORT) if self.cuts else [text], num_threads=1)))
        if b"".join(map(self.bytes_b.__getitem__, list_b)) != whole or not (self.lossless or b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole):
            return None
        b = np.array(list_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        last_a, last_b = slices(ends_a, ends_b)
        every, link_a, link_b = overlaps(ends_a, ends_b)
        # in the text of the groups a token of A stands behind the B tokens of earlier groups, one of B behind the A tokens of its own and earlier ones
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a - 1], mark_b[last_b - 1] = self.kinds, 2 * self.kinds
        size_a, size_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(last_b - size_b, size_a)] = a + mark_a
        order[np.arange(len(b)) + np.repeat(last_a, size_b)] = b + mark_b
        return ends_a, ends_b, ends_a[last_a - 1], every, "".join(self.written[order].tolist()), np.cumsum(self.width[order]), a[link_a] * self.wide + b[link_b]

    def align(self, text: str) -> Aligned | None:
        """A text at once, None where the bytes differ."""
        got = self._arrays(text)
        return got and (len(got[0]), len(got[1]), len(got[2]), got[4], got[6].tobytes())

    def align_all(self, stretches: list[str]) -> list[Aligned | None]:
        """Many stretches that begin and end with a character other than white space, as one text with a space between them."""
        got = self._arrays(" ".join(stretches)) if len(stretches) > 1 else None
        ends = np.cumsum([len(x.encode()) + 1 for x in stretches])
        if got is None or not np.isin(ends, got[2], assume_unique=True).all():
            return [self.align(x) for x in stretches]
        at_a, at_b, at_group, at_link = (np.append(0, np.searchsorted(e, ends) + 1) for e in got[:4])
        at_char = np.append(0, got[5])[at_a + at_b].tolist()
        keys, text, at_byte = got[6].tobytes(), got[4], (8 * at_link).tolist()
        n = (np.diff(x).tolist() for x in (at_a, at_b, at_group))
        return list(zip(*n, map(text.__getitem__, map(slice, at_char, at_char[1:])), map(keys.__getitem__, map(slice, at_byte, at_byte[1:]))))

    def _learn(self, rows: list[list[str]]) -> dict[str, Aligned | None]:
        """Stretches of ``rows`` not known yet; those short enough are kept, the others returned."""
        new = {x for row in rows for x in row if x not in self.known}
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, {x for row in rows for x in row}
        odd = [x for x in new if not x or x[0].isspace() or x[-1].isspace()]
        inner = list(new.difference(odd))
        made = dict(zip(inner, self.align_all(inner))) | {x: self.align(x) for x in odd}
        self.known.update((x, v) for x, v in made.items() if len(x) <= LONGEST)
        return {x: v for x, v in made.items() if len(x) > LONGEST}

    def __call__(self, texts: list[str]) -> Iterator[Aligned | None]:
        rows = [SINGLE_SPACE.split(t) if self.cuts else [t] for t in texts]
        long = self._learn(rows) if self.cuts else {}
        for text, row in zip(texts, rows):
            if not text:
                yield None
                continue
            got = [self.known[x] if x in self.known else long[x] for x in row] if self.cuts else [self.align(text)]
            if None in got:  # a stretch that is not given back: judged on the whole text
                got = [self.align(text)] if len(row) > 1 else [None]
            if None in got:
                yield None
            else:
                n_a, n_b, n_groups, groups, keys = zip(*got)
                yield sum(n_a), sum(n_b), sum(n_groups), "".join(groups)[:-1], b"".join(keys)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per pair of a task: each document's keys are distinct, so they are only counted."""
    waiting, held = [], 0

    def flush():
        keys, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            keys = np.frombuffer(raw, np.int64)
            waiting.append(keys)
            held += len(keys)
            if held >= FLUSH:
                yield flush()
                waiting, held = [], 0
    if held:
        yield flush()


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True, bound: int = BOUND) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, where kept, groups as ``a1,a2|b1;a3|b2``."""
    spark = docs.sparkSession
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    import sentencepiece

    wide = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"] + ["groups"] * keep_groups

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                rows = []
                for got in aligner(texts[a:b]):
                    if got is None:
                        rows.append((0, 0, 0, 0, "", b"", b"", ""))
                        continue
                    n_a, n_b, n_groups, groups, links = got
                    links = np.frombuffer(links, np.int64)
                    keys, times = np.unique(links, return_counts=True)
                    rows.append((n_a, n_b, n_groups, len(links), hashlib.sha256(groups.encode()).hexdigest(), keys.tobytes(), times.astype(np.int64).tobytes(), groups))
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2 + [pa.string()] * keep_groups
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary" + ", groups string" * keep_groups
    made = cut(docs.select(id_col, text_col).mapInArrow(lean(tokens), schema).withColumn("at", F.monotonically_increasing_id()), "aligned")
    counted = made.filter("n_links > 0").select("keys").mapInArrow(lean(_counted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = cut(counted.withColumn("a", F.floor(F.col("key") / wide)), "pairs")
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    pairs = cut(pairs.join(most, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    # the usual pairs: all, or those above the least power of two that keeps them within the bound
    level = F.floor(F.log2("n")).cast("int")
    least = total = 0
    for x in sorted(pairs.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += x["count"]
        if total > bound:
            least = 1 << (x["level"] + 1)
            break
    usual = pairs.filter(F.col("n") >= least).toArrow()
    order = np.argsort(usual["key"].to_numpy())
    table = spark.sparkContext.broadcast(tuple(usual[c].to_numpy()[order] for c in ("key", "n", "best")))

    def find(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, their places in the table, and which of them are there."""
        keys, known = np.frombuffer(raw, np.int64), table.value[0]
        place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        return keys, place, known[place] == keys if len(known) else np.zeros(len(keys), bool)

    out = [c for c in names if c not in ("keys", "times")] + ["at"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = table.value
        for batch in batches:
            got = []
            for raw, times in zip(batch["keys"].to_pylist(), batch["times"].to_pylist()):
                _, place, here = find(raw)
                t = np.frombuffer(times, np.int64)[here]
                got.append((int((t * n[place[here]]).sum()), int((t * best[place[here]]).sum())))
            yield pa.RecordBatch.from_arrays([batch[c] for c in out] + [pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=[*out, "count_sum", "n_best"])

    types = dict(made.dtypes)
    scored = made.mapInArrow(sums, ", ".join(f"{c} {types[c]}" for c in out) + ", count_sum long, n_best long")
    if least:
        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, raw, times in zip(batch["at"].to_pylist(), batch["keys"].to_pylist(), batch["times"].to_pylist()):
                    keys, _, here = find(raw)
                    t = np.frombuffer(times, np.int64)[~here]
                    if len(t):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), at)), pa.array(keys[~here]), pa.array(t)], names=["at", "key", "t"])

        links = made.select("at", "keys", "times").mapInArrow(rare, "at long, key long, t long").join(pairs.filter(F.col("n") < least), "key")
        more = links.groupBy("at").agg(F.sum(F.col("t") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("better"))
        scored = (scored.join(more, "at", "left").withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
                  .withColumn("n_best", F.col("n_best") + F.coalesce("better", F.lit(0))))
    last = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep_groups
    return scored.select(*last)
