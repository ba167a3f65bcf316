"""From raw documents to sampled segmentations: the corpus operators, one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's documents.

Defined results: an empty table stays empty (the last stage's columns remain); documents with null or
empty texts have a quality score like any other, are near duplicates of nothing, hit no benchmark item
and hold no personal data; where there are no labels of both kinds, every document is kept; rows that repeat
an id and its text become one, different texts of an id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontamination, neardup, pii, quality, segmentation
from colloquy.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts; it learns from the labelled ones among them."""
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return neardup.deduplicated(docs, n=5, per_cent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    windows = decontamination.item_windows(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return decontamination.clean_documents(docs, "text", windows)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.masked(docs)


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, rank, ids, log_prob, perturbed, inclusion``: the sampled segmentations of each document."""
    return segmentation.encoded(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("SentencePiece encoding and decoding", sample_segmentations),
]

#: A fitted ranking, sketches, iterated patterns and random draws are beyond SQL; tests/llm compares
#: each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
