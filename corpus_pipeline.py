"""The corpus pipeline: quality classifier, exact dedup, near-dedup, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it back as the next stage's documents, so that a lost executor never repeats a finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact, mixing, quality_model, queries, sentencepieces, simhash
from tidemark.llm.common import shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, rows and columns unchanged.

    Null text scores as empty, null ids are scored like any; repeated rows are judged alike. Null labels, and labels of
    null ids, teach nothing. Without labels every score is the same and all documents stay or go together.
    """
    return quality_model.keep_good(docs, queries.quality_machine(spark, sf_dir, docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, the one of the largest id.

    Null and empty texts are one text; a null id loses to any other; of rows that share id and text one stays.
    """
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one of the smallest id.

    Null and empty texts are linked like any others. Of rows that share an id all stay if one of them names a component;
    rows with a null id stay only where a component holds null ids alone.
    """
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, rows and columns unchanged.

    Null sources are one source, null texts have no words, null ids share one sampling key. Rows that share an id are
    taken as often as the one of them that the mix takes most.
    """
    return mixing.take_mix(docs, queries.mix_quality())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text; a document taken twice has two rows, null text has no token."""
    return sentencepieces.sentencepiece_digests(docs, queries.piece_model())


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix), ("sentencepiece", tokenize)]

#: SQL can't express the classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
