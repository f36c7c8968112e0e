"""A training-data pipeline over `documents`: each stage's rows are written as Parquet and read again by the next.

ORACLE_SQL is None: language ID and SimHash can't be expressed in SQL; tests hold the stages against brute force.

Defined results: documents whose text is null, empty or without letters are rejected by the first stage. A null doc_id loses against any other among equal texts, names no
component of near copies (its row stays) and is packed like any other. Rows of a repeated id are told apart by their texts: only the near copy among
them goes, and rows that repeat id and text are one after the second stage. Ties are broken by id: the largest stays among equal texts, the smallest among near
copies. Texts of any length are read whole. A null source is a source of its own, the last. Columns other than those of documents are left out by the
first stage, so their names can't clash. An empty table, or one without accepted documents, gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadlens.llm import common, exact_dedup, language_id, mixing, packing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id.accepted_documents(docs.select(*COLUMNS))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the largest doc_id, for each text."""
    return exact_dedup.drop_copies(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, for each component of near copies: five words, a similarity of about 0.8 by the fingerprints."""
    return simhash.drop_near(docs.select(*COLUMNS), words=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        last, docs = docs, common.materialise(stage(spark, docs, sf_dir))
        common.discard(last)
    return docs
