"""Byte-level BPE in numpy: pieces of equal length class form padded matrices, in which every row merges in step.

In each round every row looks up the ranks of its neighbour pairs in a hash table, merges its leftmost pair of minimum rank and closes the
gap; rows without a pair left leave the matrix. Only pieces not met before in a task are worked on: their ids are kept in a bounded table.
Rounds times width is quadratic in a piece's length, so pieces above ``WIDE`` bytes follow the same rule through a heap.

The table and the vocabulary travel to the tasks as a few MB of arrays, whatever the input. Documents are independent, so there
is no shuffle and a lost executor costs its tasks only.

Defined cases: a null text is an empty text, which has no ids; other columns, whatever their names, are not read. An empty table gives
an empty table; very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .memory import lean

WIDE = 256  # bytes of a piece up to which it is merged in a matrix
KEPT = 200_000  # pieces whose ids a task remembers
STRIDE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Tables:
    """Vocabulary and pair table as arrays: what the tasks need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.vocabulary = [b""] * self.size
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        bits = max(4, (2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        for key, rank in pairs.items():
            at = (key * int(STRIDE) & (1 << 64) - 1) >> (64 - bits)
            while self.keys[at] != -1:
                at = at + 1 & self.mask
            self.keys[at], self.values[at] = key, rank

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none (or where an id is negative): open addressing, all probes of a step at once."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        flat, key = out.ravel(), left.ravel()[todo].astype(np.int64) * self.size + right.ravel()[todo]
        at = (key.astype(np.uint64) * STRIDE >> self.shift).astype(np.int64)
        while len(todo):
            found = self.keys[at]
            hit = found == key
            flat[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            todo, key, at = todo[on], key[on], at[on] + 1 & self.mask
        return out

    def merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """Ids of pieces of one length class, as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(sizes.max())
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        out: list = [None] * len(rows)
        names = np.arange(len(rows))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(names):
            best = ranks.min(axis=1) if ranks.shape[1] else np.full(len(names), NONE, np.int32)
            over = best == NONE
            if over.any():
                done = ids[over]
                real = done >= 0
                ends = (4 * np.cumsum(real.sum(axis=1))).tolist()
                flat = done[real].astype("<u4").tobytes()
                for name, begin, end in zip(names[over].tolist(), [0, *ends], ends):
                    out[name] = flat[begin:end]
                ids, ranks, names, best = ids[~over], ranks[~over], names[~over], best[~over]
                if not len(names):
                    break
            at = ranks.argmin(axis=1)  # the leftmost of the smallest
            r, w = np.arange(len(names)), ids.shape[1]
            ids[r, at] = best
            source = np.arange(w - 1) + (np.arange(w - 1) > at[:, None])  # closes the gap behind the merged pair
            ids = np.take_along_axis(ids, source, axis=1)
            if w == 2:
                ranks = np.empty((len(names), 0), np.int32)
                continue
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], w - 2), axis=1)
            # only the pairs that touch the new id change
            left = at > 0
            ranks[r[left], at[left] - 1] = self.pair_ranks(ids[r[left], at[left] - 1], ids[r[left], at[left]])
            right = at < w - 2
            ranks[r[right], at[right]] = self.pair_ranks(ids[r[right], at[right]], ids[r[right], at[right] + 1])
        return out

    def _rank(self, a: int, b: int) -> int:
        key = a * self.size + b
        at = (key * int(STRIDE) & (1 << 64) - 1) >> int(self.shift)
        while True:
            found = self.keys[at]
            if found == key:
                return int(self.values[at])
            if found == -1:
                return int(NONE)
            at = at + 1 & self.mask

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a linked list and a heap ordered by (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(rank, k) for k, rank in enumerate(first) if rank != NONE]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or self._rank(ids[k], ids[j]) != rank:
                continue  # one of the two has changed meanwhile
            ids[k], ids[j], after[k] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = k
                if (new := self._rank(rank, ids[after[j]])) != NONE:
                    heapq.heappush(heap, (new, k))
            if before[k] >= 0 and (new := self._rank(ids[before[k]], rank)) != NONE:
                heapq.heappush(heap, (new, before[k]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, for each piece."""
        out: list = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if len(piece) > WIDE:
                out[k] = self.merge_long(piece).astype("<u4").tobytes()
            elif piece:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(k)
        for bits, rows in classes.items():
            step = max(1, (1 << 20) >> bits)  # a million cells at a time
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                for k, ids in zip(part, self.merge_rows([pieces[k] for k in part])):
                    out[k] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder:
    """Splits texts by the pattern and encodes each match, remembering pieces between calls."""

    def __init__(self, tables: Tables, pattern: str):
        import regex

        self.tables, self.find, self.known = tables, regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.find(t) for t in texts]
        new = {p for row in pieces for p in row if p not in self.known} if self.known else {p for row in pieces for p in row}
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, {p for row in pieces for p in row}
        order = list(new)
        self.known.update(zip(order, self.tables.encode_pieces([p.encode("utf-8", "surrogatepass") for p in order])))
        return [b"".join(map(self.known.__getitem__, row)) for row in pieces]


def chunks(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``chars`` characters, so that memory follows neither batch nor text count."""
    begin = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded (binary, from the ids alone).

    ``keep_ids=False`` gives digests of both instead: ids_sha256 and decoded_sha256.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(Tables(read_ranks(ranks_path))))  # a few MB, set by the vocabulary
    names = ["doc_id", "n_tokens", "ids", "decoded"] if keep_ids else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables.__new__(Tables)
        vars(tables).update(shared.value)
        encoder = Encoder(tables, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                ids = encoder.encode(texts[a:b])
                decoded = map(tables.decode, ids)
                both = [ids, list(decoded)] if keep_ids else [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in decoded]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, both)], names=names)

    last = "ids binary, decoded binary" if keep_ids else "ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, {last}")
