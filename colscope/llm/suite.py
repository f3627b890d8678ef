"""Queries of the numbered operators, with SQL counterparts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import alignment, bpe, chat, htmltext, jaccard, langid, mix, neardup, negatives, packing, quality, substrings, topk

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SPACE = "[^\\x20\\x09-\\x0D]+"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict, dict]:
    import corpus_pipeline

    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, {**ORACLE, **sql}


PLANTED = "\\### Assistant: </turn> ok"


@query("op2_chat_format", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}'))),
u AS (SELECT *, length(replace(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), chr(10), '%0A'), '<', '%3C'), '#', '%23'))
               + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ')) + 15 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id""")
def op2(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return chat.digests(chat.format_chats(chat.thread(turns.unionByName(planted))))


@query("op10_curriculum_mix", f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACE}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM s),
p AS (SELECT a.k, coalesce((SELECT sum(cap) FROM r WHERE r.k < a.k), 0) AS held, (SELECT sum(w) FROM r WHERE r.k >= a.k) AS open_w, (SELECT sum(source_size) FROM r) AS total, a.cap / a.w AS ratio FROM r a),
l AS (SELECT (total - held) / open_w AS level FROM p WHERE (total - held) / open_w <= ratio ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, round(least(w * level, cap), 6) AS target FROM r, l),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(floor(target + 1e-6) - upto, size), 0) + greatest(least(floor(target + 1e-6) - upto - source_size, size), 0)
        + greatest(least(floor(target + 1e-6) - upto - 2 * source_size, size), 0))::BIGINT AS taken FROM c""")
def op10(spark, sf_dir):
    placed = mix.place(table(spark, sf_dir, "documents"))
    first = F.get("copies", F.lit(0))["position"]
    # the mix in order of first use, documents that it leaves out last
    return placed.orderBy(first.asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken")


@query("op7_byte_bpe")
def op7(spark, sf_dir):
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


@query("op9_language_mixture")
def op9(spark, sf_dir):
    return langid.detect(table(spark, sf_dir, "documents"))


@query("op5_pu_quality")
def op5(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op1_vector_neardup", f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND {GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a), m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id""")
def op1(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_pivot_topk", f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE {GOOD}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def op3(spark, sf_dir):
    # rounding to a grid would hide components that are no numbers
    rows = table(spark, sf_dir, "embeddings").filter(neardup.usable(F.col("embedding"))).select("vec_id", neardup.on_grid(F.col("embedding"), 1024).alias("x"))
    return topk.top_k(rows, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


@query("op8_jaccard_join", r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
p AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.i >= 80 * (x.n + y.n - o.i)),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m.m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = doc_id""")
def op8(spark, sf_dir):
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


@query("op4_substring_dedup", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i FROM t),
g AS (SELECT s.doc_id, s.i, md5(array_to_string(t.w[s.i:s.i + 19], ' ')) AS h FROM s JOIN t USING (doc_id)),
d AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
r AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM d GROUP BY doc_id),
p AS (SELECT t.doc_id, t.w, unnest(range(1, len(t.w) + 1)) AS i FROM t),
x AS (SELECT doc_id, unnest(gone) AS i FROM r),
k AS (SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.i = p.i WHERE x.i IS NULL GROUP BY p.doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id""")
def op4(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@query("op6_dom_trees")
def op6(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("op11_differencing_pack")
def op11(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


@query("op12_token_alignment")
def op12(spark, sf_dir):
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_groups=False)


@query("op13_hard_negatives", f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND {GOOD}),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op13(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").filter(neardup.usable(F.col("embedding"))).select("vec_id", label.alias("label"), neardup.on_grid(F.col("embedding"), 256).alias("x"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)
