"""Mixing sources to target weights under a curriculum: demand curves per source, positions by inverting them, a range sort.

A source's weight may vary over training time t in [0, 1] (linear between knots). Its integral is the source's weight,
targets follow from the weights, and the k-th word that a source gives is placed at the time when its cumulative demand
reaches k. Inside a source documents follow the md5 of their id, so reruns agree, and running sums are taken in two levels
(about sqrt(n) stretches of about sqrt(n) documents), so a source with a third of all rows is no single group.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are taken 0
times and get no position; rows with the same id and size are placed next to each other in any order, as they are alike;
an empty table gives an empty mix; other columns stay as they are, so the names starting with ``__`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.order import with_position
from ..session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weight over time as knots (t, weight), dealt to the sources in turn. The integrals are 5, 2 and 1: the first kind grows, the last fades.
CURRICULUM = (((0.0, 3.0), (1.0, 7.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0)))
MAX_EPOCHS = 3

Schedule = Sequence[tuple[float, float]]


def integral(knots: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def invert(knots: Schedule, share: Column) -> Column:
    """The time at which a schedule has given ``share`` (0 to 1) of its integral: a quadratic equation per stretch."""
    total, done, out = integral(knots), 0.0, F.lit(1.0)
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        need = share * total - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
        # the form without cancellation, good for slope 0 as well
        t = F.lit(t0) + F.when(root + w0 > 0, F.lit(2.0) * need / (root + F.lit(w0))).otherwise(F.lit(0.0))
        pieces.append((done + area, t))
        done += area
    for end, t in reversed(pieces):
        out = F.when(share * total <= F.lit(end), F.least(t, F.lit(1.0))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, cap: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: __src, __none, kind (of schedule), rows, source_size, target.

    The sum of all sizes is shared by weight; a target above ``cap`` times its source's size stops there and the rest is shared
    again until none is above. Each round sends three numbers to the driver, however many sources there are.
    """
    got = sizes.groupBy("__src", "__none").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    got = with_position(got, ["__none", "__src"], "place")
    kind = F.pmod(F.col("place"), F.lit(len(schedules))).cast("int")
    weights = [integral(s) for s in schedules]
    got = cut(got.select("__src", "__none", kind.alias("kind"), "rows", "source_size", F.element_at(F.array(*map(F.lit, weights)), kind + 1).alias("weight"),
                         (F.col("source_size") * F.lit(float(cap))).alias("cap")), "sources")
    total = got.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # a capped source stays capped, since the level only rises
        full = F.col("weight") * F.lit(level) > F.col("cap")
        n, held, open_weight = got.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if (n or 0) == capped or not open_weight:
            break
        capped, level = n or 0, (total - (held or 0.0)) / open_weight
    target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return got.withColumn("target", F.round(target, 6)).drop("weight", "cap")


def named(column: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def place(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          schedules: Sequence[Schedule] = CURRICULUM, cap: int = MAX_EPOCHS, whole_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies: array<struct<position, words>> of every row.

    The copies of a source take exactly floor(target) words: the last one may be cut short, no document comes more than ``cap``
    times. With ``whole_rows`` the input row comes along as the struct ``doc``; without, only ids and sizes are moved.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    row = [F.struct(*map(named, docs.columns)).alias("doc")] if whole_rows else []
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("__none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__src"),
                        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__h"), size.alias("size"), *row)
    keyed = keyed if whole_rows else cut(keyed, "sizes")
    sources = cut(source_targets(keyed.select("__src", "__none", "size"), schedules, cap), "targets")
    # no hint: the table of sources is broadcast while its stored size is below Spark's limit, otherwise AQE splits large keys
    got = keyed.join(sources, ["__src", "__none"])
    unit = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    got = got.withColumn("__part", F.floor(unit * F.ceil(F.sqrt("rows"))))
    key = ["__src", "__none", "__part"]
    over = W.partitionBy("__src", "__none").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = cut(got.groupBy(*key).agg(F.sum("size").alias("__sum")).select(*key, F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before")), "stretches")
    inner = W.partitionBy(*key).orderBy("__h", "size").rowsBetween(W.unboundedPreceding, -1)
    got = got.withColumn("__in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(before, key).withColumn("__at", F.col("__in") + F.col("__before"))
    budget = F.floor(F.col("target") + F.lit(1e-6))

    def copy(epoch: Column) -> Column:
        start = epoch * F.col("source_size") + F.col("__at")
        share = F.when(F.col("target") > 0, start / F.col("target")).otherwise(F.lit(0.0))
        when = F.lit(None).cast("double")
        for k, s in enumerate(schedules):
            when = F.when(F.col("kind") == k, invert(s, share)).otherwise(when)
        return F.struct(when.alias("position"), F.greatest(F.least(budget - start, F.col("size")), F.lit(0)).cast("long").alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), copy), lambda c: c["words"] > 0)
    got = got.withColumn("copies", copies).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    return got.select("doc_id", "size", "source_size", "target", "taken", "copies", *(["doc"] if whole_rows else []))


def mix(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The training stream: one row per copy, range-sorted by position, as (doc, position, words).

    ``doc`` is the input row; in a copy that is cut short its text keeps the first ``words`` words.
    """
    got = place(docs, text_col=text_col, whole_rows=True, **options).select("doc_id", "size", "doc", F.explode("copies").alias("copy"))
    words, text = F.col("copy.words"), F.col("doc").getField(text_col)
    begun = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")), " ")
    got = got.withColumn("doc", F.col("doc").withField(text_col, F.when(words < F.col("size"), begun).otherwise(text)))
    return got.select("doc", F.col("copy.position").alias("position"), words.alias("words"), "doc_id").orderBy("position", "doc_id").drop("doc_id")
