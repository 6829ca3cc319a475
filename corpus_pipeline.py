"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchloom.llm import decontaminate, mixing, ngram_jaccard, suffix_dedup, toxicity
from patchloom.llm.common import materialise, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), toxicity.categories())
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at a similarity of 0.75 or more, the one
    with the smallest id stays; of repeated rows one."""
    return ngram_jaccard.drop_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside strings of 400 bytes, and words inside strings of 51 words, that also start elsewhere
    leave the text."""
    return suffix_dedup.cut(docs, suffix_dedup.either(suffix_dedup.find(docs), suffix_dedup.find_words(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    mixed = mixing.mix(docs, weights=mixing.quality_weights(read(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first and third stage fit a model and compare suffixes, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
