"""Set metrics of matches, subgroup reports and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_non_ascii
from .scoring import entity_f


def entity_metrics(entities: DataFrame, truth: DataFrame, decided: DataFrame) -> DataFrame:
    """(qid, positives, predicted, tp, candidate_hits, routed, pairs, f) of every entity, with or without candidates.

    truth (qid, tid); decided (qid, tid, accepted, routed) holds all candidates.
    """
    marked = decided.join(truth.select("qid", "tid", F.lit(1).alias("hit")), ["qid", "tid"], "left")
    sums = marked.groupBy("qid").agg(
        F.count_if("accepted").alias("predicted"), F.count_if(F.col("accepted") & F.col("hit").isNotNull()).alias("tp"),
        F.count_if(F.col("hit").isNotNull()).alias("candidate_hits"), F.count_if("routed").alias("routed"), F.count(F.lit(1)).alias("pairs"),
    )
    positives = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("positives"))
    names = ["positives", "predicted", "tp", "candidate_hits", "routed", "pairs"]
    every = entities.join(positives, "qid", "left").join(sums, "qid", "left").fillna(0, names)
    return every.withColumn("f", entity_f(F.col("tp"), F.col("predicted"), F.col("positives")))


def rollup(items: DataFrame, *keys: str) -> DataFrame:
    """Macro F0.5, micro precision and recall, candidate recall and totals."""
    at_least_one = lambda c: F.greatest(F.sum(c), F.lit(1))
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entities"), F.avg("f").alias("macro_f05"), (F.sum("tp") / at_least_one("predicted")).alias("precision"), (F.sum("tp") / at_least_one("positives")).alias("recall"),
        (F.sum("candidate_hits") / at_least_one("positives")).alias("candidate_pair_recall"), *[F.sum(c).alias(c) for c in ("tp", "predicted", "positives", "candidate_hits", "routed", "pairs")],
    )


def tags(positives: Column, name: Column, address: Column, country: Column, raw: Column) -> Column:
    """The report groups an entity is in."""
    missing = (name == "") | (address == "") | (country == "")
    return F.array_compact(F.array(F.lit("all"), F.concat(F.lit("country:"), country), F.when(positives == 0, F.lit("singleton")), F.when(missing, F.lit("missing_field")), F.when(has_non_ascii(raw), F.lit("non_ascii"))))


def by_tag(items: DataFrame, records: DataFrame) -> DataFrame:
    """Reports by tag. records: qid, business_name, business_address, country, raw."""
    joined = items.join(records, "qid")
    return rollup(joined.withColumn("tag", F.explode(tags(F.col("positives"), *[F.col(c) for c in ("business_name", "business_address", "country", "raw")]))), "tag")


def by_source(entities: DataFrame, truth: DataFrame, decided: DataFrame, sources: list[int]) -> DataFrame:
    """Reports with truth and predictions of one target source; both inputs carry `source`."""
    wide = entities.withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources])))
    key = lambda df: df.withColumn("qid", F.struct("qid", F.col("source").cast("int").alias("source")))
    items = entity_metrics(key(wide).select("qid"), key(truth), key(decided))
    return rollup(items.withColumn("source", F.col("qid.source")), "source")


def recall_at(ranked: DataFrame, truth: DataFrame, ks: list[int], rank: str = "rank") -> DataFrame:
    """(k, pair_recall, any_recall, all_recall) of a ranked candidate table over queries with truths."""
    hits = truth.select("qid", "tid").join(ranked.select("qid", "tid", rank), ["qid", "tid"], "left")
    wide = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    each = wide.groupBy("k", "qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(rank) <= F.col("k"), F.lit(False))).alias("h"))
    return each.groupBy("k").agg((F.sum("h") / F.sum("n")).alias("pair_recall"), F.avg((F.col("h") > 0).cast("double")).alias("any_recall"), F.avg((F.col("h") == F.col("n")).cast("double")).alias("all_recall"))


def threshold_sweep(scored: DataFrame, entities: DataFrame, truth: DataFrame, thresholds: list[float], score: str = "x") -> DataFrame:
    """Reports by threshold: pairs at or above it are predicted. The list is a parameter, not data."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    wide = entities.withColumn("threshold", F.explode(levels))
    pairs = scored.withColumn("threshold", F.explode(levels))
    key = lambda df: df.withColumn("qid", F.struct("qid", "threshold"))
    decided = key(pairs.withColumn("accepted", F.col(score) >= F.col("threshold")).withColumn("routed", F.lit(False)))
    items = entity_metrics(key(wide).select("qid"), key(truth.withColumn("threshold", F.explode(levels))), decided)
    return rollup(items.withColumn("threshold", F.col("qid.threshold")), "threshold")


def oracle_ceiling(entities: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """The report of a perfect decision over the candidates."""
    perfect = candidates.join(truth.select("qid", "tid"), ["qid", "tid"]).select("qid", "tid", F.lit(True).alias("accepted"), F.lit(False).alias("routed"))
    return rollup(entity_metrics(entities, truth, perfect))
