"""From raw documents to token ids: language filter, near-duplicates, repeated passages, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. ``run`` writes every stage as Parquet to the shared folder and
reads it again, so a lost executor costs the tasks of one stage.

In every stage a null text is an empty text, repeated rows are copies of one document, an empty table gives an empty table, and other columns
come along under their names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colscope.llm import bpe, jaccard, langid, mix, substrings
from colscope.llm.mix import named
from colscope.session import cut

#: A text whose leading language has a smaller share than this is rejected, as is one without letters.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a leading language; ties and repeated rows are judged alike."""
    rows = docs.select(whole(docs))
    named = docs.filter(~F.coalesce(langid.held_out("doc_id", 3, 1), F.lit(False)))
    langs, table = langid.learn(named)
    judged = langid.predict(rows, langs, table, ["row"], "row.text")
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("row.*")


def whole(docs: DataFrame) -> Column:
    return F.struct(*map(named, docs.columns)).alias("row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id (null last, then by text) of each group of linked rows; rows without words all stay.

    Rows with equal id and text are one document, of which the row with the smallest hash over all columns stays.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text")).alias("id")
    groups = jaccard.jaccard_groups(docs.select(own, "text"), "id")
    stay = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(own, whole(docs)).groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))  # copies meet before the shuffle
    return rows.join(stay, "id", "left_semi").select("row.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier; a document of which nothing stays goes, others keep their text where nothing was removed."""
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("null"), *[named(c).alias(f"c{i}") for i, c in enumerate(other)]).alias("own"))
    got = substrings.remove_repeats(rows, carry=["own"]).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(~F.col("row.own.null"), F.col("kept"))
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(f"row.own.c{i}") for i, c in enumerate(other)}
    return got.select(*[made[c].alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream in order: up to three copies of a document, the last words of a source's target cut at a word."""
    rows = mix.mix(docs).select("doc.*")
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and digests of the ids and of what they decode to, for each row of the stream."""
    import public_tokenizers

    got = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("source_mix", source_mix), ("tokens", tokens)]
#: Language likelihoods and BPE have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
