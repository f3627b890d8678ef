"""What a tokenizer file says about itself: whether it is a plain byte-level BPE by ranks, and where a text may be cut without changing its tokens.

A byte-level BPE that splits by the usual pattern starts a new piece at a single space between other characters, and a BPE over pieces never merges across
it where no piece of its vocabulary holds the space mark behind another character. So long texts can be worked on in segments that end there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
SEGMENT = 1 << 15  # characters after which the next single space ends a segment
# fixed value: how the byte-level pre-tokenizer splits
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
FROM_CHAR = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


def byte_level(entry: str) -> bytes:
    """Bytes of a byte-level entry: printable Latin-1 characters stand for themselves, the other bytes for 256 and on, in order."""
    return bytes(FROM_CHAR[c] for c in entry)


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text cut at single spaces, each left out, into parts of at least ``size`` characters (but the last)."""
    out, at = [], 0
    while len(text) - at > size and (m := SINGLE_SPACE.search(text, at + size)):
        out.append(text[at:m.start()])
        at = m.end()
    return [*out, text[at:]]


def _plain(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    return not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("post_processor")


def cuts_at_spaces(tokenizer_json: str) -> bool:
    """True if the tokenizer's own splitting starts a piece at every single space."""
    return _plain(json.loads(tokenizer_json))


def by_ranks(tokenizer_json: str, special: bool):
    """The same byte-level BPE as a tiktoken encoding, None where the file describes anything else.

    With one merge for every entry beyond the bytes and ids in the order of the merges, the pair of least rank is the pair whose entry has the least id: what stands inside an
    entry's bytes goes through the same merges as the entry alone, so any two neighbours that make it up are the two of its merge.
    """
    import tiktoken

    spec = json.loads(tokenizer_json)
    model, added = spec["model"], spec.get("added_tokens") or []
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or odd or not _plain(spec) or any(a.get(k) for a in added for k in ("lstrip", "rstrip", "normalized", "single_word")):
        return None
    names = {a["content"]: a["id"] for a in added if special or not a.get("special")}
    vocab = {k: i for k, i in model["vocab"].items() if k not in {a["content"] for a in added}}
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [vocab.get(m, -1) for m in made]
    whole = all(set(k) <= FROM_CHAR.keys() for k in vocab) and len({k for k in vocab if len(k) == 1}) == 256
    if not whole or -1 in ids or any(a >= b for a, b in zip(ids, ids[1:])) or len(ids) + 256 != len(vocab):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={byte_level(k): i for k, i in vocab.items()}, special_tokens=names)


def batches_of(texts: list[str], chars: int = 1 << 18) -> Iterator[list[str]]:
    """Consecutive texts with about ``chars`` characters, so that a library's results for many texts never wait together."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= chars:
            yield held
            held, total = [], 0
    if held:
        yield held
