"""Packing of token sequences into windows by multiway differencing (Karmarkar-Karp).

A document's ids and its end mark are cut into full windows and a tail, the tail into a half and a quarter window where it is that long, and a rest.
Pieces are dealt into groups of about ``GROUP`` by their place in the written table, so that copies and hot sources spread evenly. In a group
every piece starts as a partial partition of k windows, all but one of them empty. The two partial partitions with the largest imbalance are merged, the
fullest windows of one on the emptiest of the other, until one is left with k nearly equal windows. k starts at the least number that could
hold the ids and rises whenever a window exceeds its capacity.

Ids are made once; what is shuffled is a line per piece (with its ids only where the caller asks for them). Copies of a piece's line are never made.

Defined cases: a null text is an empty text, which has the end mark alone; repeated rows and rows with equal or null ids are documents of their own;
a text of any length is cut, none is held back; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .bpe import chunks
from .memory import lean
from .stretches import batches_of, by_ranks

WINDOW, GROUP = 2048, 4096


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Sums and items of k windows, fullest first (empty windows are left out)."""
    n = len(sizes)
    parts = {i: (np.array([s]), np.array([i])) for i, s in enumerate(sizes.tolist())}
    heap = [(-s, i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    joined: list[tuple[int, int]] = []  # window n + i holds the two windows of joined[i]
    for made in range(n, 2 * n - 1):
        (a, wa), (b, wb) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        meet = max(len(a) + len(b) - k, 0)  # windows of both that must share a place: the emptiest of one with the emptiest of the other, crosswise
        i, j = len(a) - meet, len(b) - meet
        first = n + len(joined)
        joined.extend(zip(wa[i:].tolist(), wb[j:][::-1].tolist()))
        sums = np.concatenate([a[:i], b[:j], a[i:] + b[j:][::-1]])
        windows = np.concatenate([wa[:i], wb[:j], np.arange(first, first + meet)])
        order = np.argsort(-sums, kind="stable")
        sums, windows = sums[order], windows[order]
        parts[made] = sums, windows
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), made))
    sums, windows = parts.popitem()[1]

    def items(w: int) -> list[int]:
        stack, out = [w], []
        while stack:
            w = stack.pop()
            if w < n:
                out.append(w)
            else:
                stack.extend(joined[w - n])
        return out

    return sums, [items(w) for w in windows.tolist()]


def pack_sizes(sizes: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """Items of each window; no window holds more than ``window``."""
    full = np.flatnonzero(sizes >= window)
    rest = np.flatnonzero(sizes < window)
    out = [[i] for i in full.tolist()]
    if len(rest):
        s = sizes[rest]
        k = max(-(-int(s.sum()) // window), int((2 * s > window).sum()), 1)
        while True:
            sums, windows = differencing(s, k)
            over = int(np.maximum(sums - window, 0).sum())
            if not over:
                break
            k += max(1, over // window)
        out += [rest[w].tolist() for w in windows]
    return out


def piece_lengths(n: int, window: int = WINDOW) -> list[int]:
    """Full windows, then a half and a quarter window where the tail holds them, then the rest."""
    out = [window] * (n // window)
    n %= window
    for part in (window // 2, window // 4):
        if 0 < part <= n:
            out.append(part)
            n -= part
    return out + [n] if n else out


class Ids:
    """Little-endian unsigned 32-bit ids of texts by a tokenizer file, without added special tokens: by ranks where the file is a plain byte-level BPE, else by its own library."""

    def __init__(self, tokenizer_json: str):
        self.ranks = by_ranks(tokenizer_json, special=True)
        if not self.ranks:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
            self.tokenizer = Tokenizer.from_str(tokenizer_json)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if self.ranks:
            return (self.ranks.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() for t in texts)
        return (np.array(e.ids, "<u4").tobytes() for some in batches_of(texts) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, with its ids (binary) where they are kept."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i, ids in enumerate(ids_of(texts[a:b]), a):
                    ids += end
                    at = 0
                    for n in piece_lengths(len(ids) // 4, window):
                        own = ids[4 * at:4 * (at + n)]
                        row.append(i), start.append(at), length.append(n), crc.append(zlib.crc32(own)), total.append(len(ids) // 4)
                        if keep_ids:
                            kept.append(own)
                        at += n
                cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_ids, names=names)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Every piece with its sequence_id and offset: each id of each document lies in one place, no sequence exceeds ``window`` ids."""
    made = cut(pieces(docs, tokenizer_path, window, end_id, id_col, text_col, keep_ids).withColumn("at", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-made.count() // GROUP))
    kind = dict(made.dtypes)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)  # the same windows whatever order the rows came in
        windows = pack_sizes(pdf["length"].to_numpy(), window)
        rows = np.concatenate([np.array(w) for w in windows])
        size = pdf["length"].to_numpy()[rows]
        number = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        before = np.cumsum(size) - size
        first = np.r_[True, number[1:] != number[:-1]]
        out = pdf.iloc[rows].drop(columns="at")
        out["sequence_id"] = pdf["grp"].iat[0] + groups * number
        out["offset"] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(rows)]))
        return out.drop(columns="grp")

    names = [c for c in made.columns if c != "at"]
    schema = ", ".join(f"{c} {kind[c]}" for c in names) + ", sequence_id long, offset long"
    return made.withColumn("grp", F.pmod(F.xxhash64("at"), F.lit(groups))).groupBy("grp").applyInPandas(place, schema)
