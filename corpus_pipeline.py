"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet to
the shared folder and reads it again as the next one's docs. All but the last keep the columns of documents.

Defined cases, in every stage: null and empty texts are kept as they are (they are one class of near copies, so one of
them stays after that stage); rows with a null doc_id and repeated rows are documents like others; a doc_id with several
texts is several documents; very long texts are worked on whole; an empty table gives an empty result; other columns
pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freightspark.functions.shared import cut
from freightspark.llm import decontamination, line_dedup, near_dedup, sentencepiece_codec, toxicity
from freightspark.llm.common import table
from freightspark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents among these; those that score as toxic go. Without labels nothing goes; a null text is never toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, but for the first (ties: the least doc_id, then place); the documents stay, also where nothing is left of a text."""
    return line_dedup.remove_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the least doc_id, then the least text; of equal rows one."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null items and items of fewer than eight tokens match nothing."""
    return decontamination.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, checked against the sentencepiece library and decoded again; a null text has no ids."""
    return sentencepiece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", to_ids),
]

#: SQL has no counterpart of the learned, sampled and tokenizing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
