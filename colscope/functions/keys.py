"""Row-key hashing: splits, folds, block numbers and samples that do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_SPACE = 16**8


def _as_cols(keys) -> list[Column]:
    keys = [keys] if isinstance(keys, (str, Column)) else list(keys)
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def key_hash(keys, seed: int | str = 1) -> Column:
    """md5 over ``seed:key1:key2..`` as lower-case hex, the same text any SQL engine produces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in _as_cols(keys)]))


def hex_bound(fraction: float) -> str:
    """Eight hex digits below which the given fraction of all hashes falls."""
    bound = min(max(int(fraction * HEX_SPACE), 0), HEX_SPACE)
    return f"{bound:08x}" if bound < HEX_SPACE else "g"


def below(keys, fraction: float, seed: int | str = 1) -> Column:
    """True for about ``fraction`` of the keys; fixed for a key and seed."""
    return F.substring(key_hash(keys, seed), 1, 8) < F.lit(hex_bound(fraction))


def is_test(keys, fraction: float = 0.3, seed: int = 1) -> Column:
    return below(keys, fraction, seed)


def fold(keys, n: int = 3, seed: int = 1) -> Column:
    """Fold number 0..n-1 from the second eight hash digits, independent of :func:`is_test`."""
    digits = F.substring(key_hash(keys, seed), 9, 8)
    out = F.lit(0)
    for i in range(1, n):
        out = out + (digits >= F.lit(hex_bound(i / n))).cast("int")
    return out


def block(keys, n: int, seed: int = 0) -> Column:
    """Block number 0..n-1 for spreading rows; a JVM hash, as no other engine needs to repeat it."""
    return F.pmod(F.xxhash64(F.lit(seed), *_as_cols(keys)), F.lit(n)).cast("int")
