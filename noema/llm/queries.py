"""Queries of this subpackage: thin wrappers that read whole tables and call an operator each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import vectors

    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import substrings

    found = substrings.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import decontaminate

    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import language_model

    return language_model.score(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from noema.llm import pieces
    from noema.llm.staging import prepare

    prepare(spark)
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_documents(documents, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import toxicity

    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import pii

    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long) AS n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest("spans"), 256).alias("base_sha256"), pii.digest("all_spans").alias("spans"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import html_text
    from noema.llm.staging import prepare

    prepare(spark)
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import langid

    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import lexical

    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noema.llm import mixing

    documents = _table(spark, sf_dir, "documents")
    return mixing.mix(documents, mixing.cyclic_weights(documents, (3, 1, 2))).select("doc_id", "size", "source_size", "target", "taken")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from noema.llm import alignment

    pair = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(_table(spark, sf_dir, "documents"), *pair)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Hash and order are those of the operator's contract: md5 of seed and id, then id and size; equal rows share evenly.
MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('12:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
s AS (
  SELECT source, source_size, 2 * source_size AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
total AS (SELECT 150 * sum(source_size)::BIGINT AS budget FROM s),
-- water-filling: each step clamps the sources whose share at the level lies above the cap
fill(step, level, clamped) AS (
  SELECT 0, (SELECT budget FROM total)::DOUBLE / (100 * (SELECT sum(weight)::BIGINT FROM s WHERE weight > 0))::DOUBLE, 0::BIGINT
  UNION ALL
  SELECT step + 1,
    (SELECT (any_value(t.budget) - 100 * coalesce(sum(cap) FILTER (weight * level > cap), 0)::BIGINT)::DOUBLE
       / (100 * sum(weight) FILTER (weight * level <= cap)::BIGINT)::DOUBLE FROM s, total t),
    (SELECT count(*) FROM s WHERE weight * level > cap)
  FROM fill WHERE (SELECT count(*) FROM s WHERE weight * level > cap) > clamped
    AND EXISTS (SELECT 1 FROM s WHERE weight * level <= cap)),
top AS (SELECT level FROM fill ORDER BY step DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(weight * level, cap::DOUBLE) ELSE 0.0 END AS target FROM s, top),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    floor(target + 0.5)::BIGINT - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS rest FROM t),
c AS (SELECT source, doc_id, size, hash, count(*) AS copies FROM d GROUP BY ALL),
p AS (
  SELECT *, coalesce(sum(size * copies) OVER (PARTITION BY source ORDER BY hash, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (r.whole * d.size + greatest(0, least(d.size, (r.rest - p.before) // p.copies)))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.size = p.size
JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

SEARCH = r"""
WITH terms AS (
  SELECT rowid_ AS row_, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid_ FROM documents)),
tf AS (SELECT row_, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY row_, term),
doc AS (SELECT row_, sum(tf)::BIGINT AS n FROM tf GROUP BY row_),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM doc),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY term, docs),
m AS (SELECT row_, 100 - 25 + ((25 * n * docs) // words) AS m FROM doc, a),
q AS (
  SELECT i, item_id, term, count(*) AS q
  FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT item_id, text, row_number() OVER () AS i FROM benchmark))
  GROUP BY ALL),
scored AS (
  SELECT i, item_id, row_, any_value(doc_id) AS doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row_) GROUP BY i, item_id, row_)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op11_lexical_search": SEARCH, "op12_source_mix": MIX}
