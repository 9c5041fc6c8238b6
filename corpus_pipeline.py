"""The training-text pipeline: stages over ``documents``, each stage's result written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dyadspark.llm import decontaminate, jaccard_join, piece_codec, toxicity, unit_dedup
from dyadspark.llm.queries import PIECES
from dyadspark.llm.tables import documents, table
from dyadspark.session import materialise


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model rejects go; it is fitted on the documents it is given."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the document with the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences are cut from all documents but the first that holds them."""
    return unit_dedup.dedup_units(docs, spans_column=None)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a test item of ``benchmark`` is found go."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the document's pieces, their number, and the text read back from the ids."""
    return piece_codec.encode(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", keep_one_of_group),
    ("substring_dedup", remove_repeats),
    ("benchmark_decontamination", remove_benchmark),
    ("piece_codec", encode_pieces),
]

#: Trained weights and shingle sets have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
