"""Stages of the corpus pipeline: what each operator's result does to the documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridevents.llm.neardup import near_duplicates
from gridevents.llm.packing import pack
from gridevents.llm.passages import passages, without_passages
from gridevents.llm.quality import passing
from gridevents.llm.secrets import redacted
from gridevents.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rules reject go."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every class stays, once; rows without doc_id stay as they are."""
    kept = written(near_duplicates(docs).where("is_kept").select("doc_id"), "kept")
    return (docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
                .unionByName(docs.where("doc_id IS NULL")))


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every repeated passage stays in the document of smallest id and is cut from all others."""
    return without_passages(docs, written(passages(docs), "passages"))


def secret_scan(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The values of secrets are replaced."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The ids of all documents in sequences: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    # workers outlive the stage, so they remember fewer words here, at the cost of tokenizing rare ones again
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), known_words=100_000, resting_words=50_000, slice_bytes=1 << 20)
