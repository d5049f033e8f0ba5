"""Labels, leakage isolation and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import top_per_group


def held_out_targets(truth: DataFrame, splits: DataFrame) -> DataFrame:
    """Distinct targets that are positives of a query outside `fit`."""
    return truth.join(splits.where(F.col("split") != "fit").select("qid"), "qid").select("tid").distinct()


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where the truth has them."""
    known = truth.select("qid", "tid", F.lit(1).alias("_known"))
    return pairs.join(known, ["qid", "tid"], "left").withColumn("label", F.coalesce("_known", F.lit(0))).drop("_known")


def isolate(pairs: DataFrame, truth: DataFrame, splits: DataFrame) -> DataFrame:
    """For split `fit`, drops pairs whose target is a positive of any query of another split. Needs `split`."""
    held = held_out_targets(truth, splits).withColumn("_held", F.lit(True))
    return pairs.join(held, "tid", "left").where((F.col("split") != "fit") | F.col("_held").isNull()).drop("_held")


def supervised_pairs(pairs: DataFrame, truth: DataFrame, splits: DataFrame, split: str | None = None) -> DataFrame:
    """Labelled pairs of one split or of all, leakage removed."""
    chosen = splits if split is None else splits.where(F.col("split") == split)
    return labelled(isolate(pairs.join(chosen, "qid"), truth, splits), truth)


def hard_negatives(ranked: DataFrame, truth: DataFrame, splits: DataFrame, per_query: int, rank: str = "tfidf_rank") -> DataFrame:
    """(qid, tid, source): of each query and source the first `per_query` retrieved targets that are no truths and no held-out positives."""
    use = ranked.join(splits.where(F.col("split").isin("fit", "dev")), "qid").join(truth.select("qid", "tid"), ["qid", "tid"], "left_anti")
    best = top_per_group(isolate(use, truth, splits), ["qid", "source"], [F.col(rank)], per_query, "_n")
    return best.select("qid", "tid", "source", "split")


def training_examples(truth: DataFrame, negatives: DataFrame, splits: DataFrame, per_query: int, order: list) -> DataFrame:
    """(qid, tid, label, split): positives, then up to `per_query` negatives of each query by `order`; a pair stays once, as a positive if it is one."""
    use = splits.where(F.col("split").isin("fit", "dev"))
    positives = isolate(truth.select("qid", "tid").join(use, "qid"), truth, splits).select("qid", "tid", F.lit(1).alias("label"), "split")
    best = top_per_group(negatives.join(truth.select("qid", "tid"), ["qid", "tid"], "left_anti"), ["qid", "split"], order, per_query, "_n")
    every = positives.unionByName(best.select("qid", "tid", F.lit(0).alias("label"), "split"))
    return every.groupBy("qid", "tid", "split").agg(F.max("label").alias("label")).select("qid", "tid", "label", "split")


def insert_or_ignore(rows: DataFrame, keys: list[str], priority: list) -> DataFrame:
    """The first row of each key by `priority`."""
    return top_per_group(rows, keys, priority, 1, "_n").drop("_n")
