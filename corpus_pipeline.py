"""Corpus pipeline over `documents`.

Five stages in order; each takes the Parquet that the one before wrote, and all but the last return the
columns of documents. Models are fitted on the labelled rows among a stage's own input.

Defined results: null, empty and blank texts fail the quality rules; rows with a null id pass the filters and near-dedup,
lose no words and are packed under a null id; rows that repeat an id are judged one by one; other columns go
through as they are, whatever their names, but for `n_chars`, which follows a text that loses words; an empty
table runs through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm import gray_simhash, packing, quality_forest, substring_dedup, toxicity
from weftlink.session import drop_path, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hard rules and the isolation forest keep."""
    return quality_forest.keep(docs, quality_forest.fit(docs, table(spark, sf_dir, "labels")))


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=toxicity.fold() != 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of texts whose sets of five-word shingles are 80 % alike."""
    return gray_simhash.one_of_each(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a 50-word window of an earlier document covers; a document left without a word goes."""
    return substring_dedup.strip_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence."""
    # workers outlive their stage and keep their words, so the store is smaller than where packing runs alone
    return packing.pack(docs, packing.vocabulary(), cached_words=100_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", clean_language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models and tokenization are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
