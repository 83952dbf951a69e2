"""A training-data pipeline over `documents`: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from syndromeframe.llm import common, hamming, langid, mixing, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, finds good; all of them without labels of both kinds.

    Null and empty texts have the prior's score, repeated rows are judged each by itself; columns stay unchanged, and an
    empty table gives an empty one.
    """
    return quality.good(docs, common.table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read as one of the languages learned from `lang`; all of them if nothing can be learned.

    Null and empty texts and texts without a letter go; columns stay unchanged; an empty table gives an empty one.
    """
    return langid.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id.

    Null and blank texts are one group; of rows that repeat an id and text one stays; columns stay unchanged; an empty
    table gives an empty one.
    """
    return hamming.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, interleaved by target weights: each source's share, none above mixing.MOST_SHARE.

    What a source has beyond its weight follows in later phases. The files and their rows hold the order, which the next
    stage's sequences follow. A null source is one of its own; repeated rows stay as often as they are; columns stay
    unchanged; an empty table gives an empty one.
    """
    return mixing.interleaved(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of packing.CAPACITY tokens, by sequence_id in the mix's order.

    A null or empty text is one piece with the end token alone; null ids stay null; an empty table gives no piece.
    """
    return packing.pack_documents(docs, in_order=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't train the models or run the searches of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
