"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bitplane, chroma, langid, lm, minhash, mixing, packing, toxicity, warc
from .common import fold, table
from .tokens import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=85).drop("text_hash")


#: Domains of the labelled table, and the shares of the mix's tokens that each should have.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}


def labelled_domains(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def op2_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, domains = mixing.mix(table(spark, sf_dir, "documents"), labelled_domains(table(spark, sf_dir, "labels")), TARGETS)
    each = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)]
    return mixed.select(F.col("id").alias("doc_id"), "n_tokens", *each, "rate", "copies")


def op3_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(toxicity.sample(docs.where(~out).select("doc_id", "text"), labels.where(~out)))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "near")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op6_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold(F.col("doc_id"), 7) == 2
    scored = lm.score(table(spark, sf_dir, "documents"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_bitplane_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitplane.write_ids(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY), end_id=2)
    return bitplane.read_ids(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    known = langid.profiles(docs.where(~out))
    return langid.identify(docs, known).withColumnRenamed("id", "doc_id").select("doc_id", out.alias("held_out"), "lang_pred", "score", "distance")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY), end_id=1, size=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = chroma.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", decode=chroma.rendered)
    return chroma.align(prints, table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("id"))).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_duplicates": op1_minhash_near_duplicates,
    "op2_soft_membership_mixing": op2_soft_membership_mixing,
    "op3_toxicity_neighbours": op3_toxicity_neighbours,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_cross_polytope_neighbours": op5_cross_polytope_neighbours,
    "op6_log_bilinear_scores": op6_log_bilinear_scores,
    "op7_bitplane_round_trip": op7_bitplane_round_trip,
    "op8_language_profiles": op8_language_profiles,
    "op9_packing": op9_packing,
    "op10_chroma_alignment": op10_chroma_alignment,
}

_NEAR = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM each x JOIN each y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), sym AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON sets.doc_id = least.a
"""

_WARC = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS p FROM pages
), hashed AS (
  SELECT page_id, CAST(octet_length(p) AS BIGINT) AS payload_bytes, sha1(p) AS h FROM payloads
), digests AS (
  SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS main
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = main THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> main THEN main END AS refers_to
FROM digests
"""

SQL: dict[str, str] = {"op1_minhash_near_duplicates": _NEAR, "op4_warc_round_trip": _WARC}
