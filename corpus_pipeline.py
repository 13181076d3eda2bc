"""The corpus pipeline: documents in, packed training pieces out.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept: documents that the classifier chain rejects go; one document
of each group of near duplicates stays; of passages that repeat only the first
occurrence stays; the sources are mixed to their target weights; and the rest is
packed. ``run`` writes each stage's result to the shared folder and reads it for
the next. No SQL expresses the whole of it, so ORACLE_SQL is None and the tests
hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import mixing, ngram_join, packing, substring_dedup, toxicity
from riskweave.llm._spark import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the folder's ``labels``, doesn't reject.

    Null and empty texts are scored by the intercepts and so are kept or rejected
    alike; rows that repeat are judged alike; without labels all stay.
    """
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id (null counts as the last); all rows without words stay."""
    return ngram_join.deduplicate(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages of 50 words or more that are in an earlier place (by doc_id, null last) too; n_chars follows."""
    return substring_dedup.remove(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch that takes a document, at the end of a leaf's prefix with its first tokens only; rows without tokens are never taken."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their texts; a document that was taken more than once is in no bin twice; rows without tokens give none."""
    return packing.pack(docs, with_text=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of a folder; each one's rows are written to the shared folder, and what the one before wrote goes when the next is written."""
    docs, drop = read(spark, sf_dir, "documents"), lambda: None
    for _, stage in STAGES:
        docs, gone = stored(stage(spark, docs, sf_dir), "pipeline")
        drop()
        drop = gone
    return docs
