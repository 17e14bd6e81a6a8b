"""The corpus pipeline: five stages over documents, each one operator of evidentia.llm over all that the stage before it kept.

Rows out: one for each piece of a remaining document, as placed by the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm.common import table, written
from evidentia.llm.decontaminate import decontaminated
from evidentia.llm.near_copies import deduplicated
from evidentia.llm.packing import pack
from evidentia.llm.suffixes import without_repeats
from evidentia.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not predict as toxic; null and empty texts stay, repeated rows share one fate."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: found by SimHash, and by MinHash where they differ in more than four bits, then checked by whole sets (a Jaccard
    similarity of five-word shingles of 0.8 and more), directly or over others."""
    return deduplicated(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes and more that an earlier one has; n_chars counts what is left."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none and stay, repeated rows share one fate."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens; null and empty texts are their end token alone, repeated rows are packed each."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Tokenizer, grammar and fingerprints have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written as Parquet into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
