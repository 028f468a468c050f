"""The ``opN_<name>`` queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, language_model, mixing, quality_model, rules, secret_scan, sentencepieces, simhash, substrings, warc
from .common import crc_bucket, table, text_or_empty


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score_documents(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 7) != 2)
    return scored.withColumn("held_out", crc_bucket("doc_id", 7) == 2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), output="sha").withColumnRenamed("kept", "kept_sha256")


def mix_quality():
    """Sampling weight of a document: less for a larger share of symbols, between 0.05 and 1."""
    t = text_or_empty()
    plain = F.char_length(F.translate(t, "#*$%&|<>!", ""))
    return F.greatest(F.lit(0.05), 1 - 5.0 * (F.char_length(t) - plain) / F.greatest(F.char_length(t), F.lit(1)))


MIX_QUALITY_SQL = "greatest(0.05, 1 - 5.0::double * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!]', '', 'g'))) / greatest(length(coalesce(text, '')), 1))"


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mix_quality())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.fit(secret_scan.labelled_findings(spark)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def quality_machine(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality_model.Machine:
    """The classifier, fitted on labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    return quality_model.train(docs, labels.where(crc_bucket("doc_id", 5) != 0))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_machine(spark, sf_dir, docs))
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality_model.CUT).cast("int").alias("predicted"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.sentencepiece_digests(table(spark, sf_dir, "documents"), piece_model())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_language_model, op3_substring_dedup, op4_mixing, op5_secret_scan, op6_warc, op7_exact_dedup, op8_quality_classifier, op9_sentencepiece, op10_quality_rules)}

ORACLE_SQL = {
    "op3_substring_dedup": substrings.repeats_sql(),
    "op6_warc": """
        SELECT page_id, n::bigint AS payload_bytes, sha1(p) AS payload_digest, CASE WHEN n < 1000 OR page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS p, octet_length(encode(coalesce(html, ''))) AS n FROM pages) WINDOW g AS (PARTITION BY p)""",
    "op4_mixing": mixing.mix_sql(MIX_QUALITY_SQL),
    "op10_quality_rules": rules.rules_sql(),
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
}
