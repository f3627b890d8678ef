"""Helpers of the registered queries: table access, rounding, and the SQL text of the hash split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.keys import hex_bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round the double columns, so that the order of additions does not show."""
    cols = only or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in cols})


def sql_hash(key: str, seed: int | str = 1) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in key.split(','))}))"


def sql_below(key: str, fraction: float, seed: int | str = 1) -> str:
    return f"(substr({sql_hash(key, seed)}, 1, 8) < '{hex_bound(fraction)}')"


def sql_fold(key: str, n: int = 3, seed: int | str = 1) -> str:
    parts = [f"CAST(substr({sql_hash(key, seed)}, 9, 8) >= '{hex_bound(i / n)}' AS INTEGER)" for i in range(1, n)]
    return "(" + " + ".join(parts) + ")"


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
