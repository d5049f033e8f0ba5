"""Bounded labelled snapshot of reference records, their matches and near misses."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import explorer_normal, sequence_ratio
from ..operators import validate
from ..operators.sampling import top_per_group
from ..session import cut
from ..sources.tsv import RECORD_FIELDS, explode_truth, read_sources, read_truth
from ..storage import Storage

NEGATIVES, POOL = 4, 2000


def selection_hash(seed: int, entity_id: Column, kind: str = "") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:{kind + ':' if kind else ''}"), entity_id), 256)


def chosen_queries(references: DataFrame, most: int, seed: int) -> DataFrame:
    return references.orderBy(selection_hash(seed, F.col("entity_id"))).limit(most)


def background(targets: DataFrame, positives: DataFrame, seed: int, pool: int = POOL) -> DataFrame:
    """Of each source the `pool` targets with the smallest hash that are no positives."""
    others = targets.join(positives, "entity_id", "left_anti").withColumn("_h", selection_hash(seed, F.col("entity_id"), "target"))
    return top_per_group(others, ["source"], [F.col("_h")], pool, "_n").drop("_h", "_n")


def near_misses(queries: DataFrame, pool: DataFrame, truth: DataFrame, per_source: int = NEGATIVES) -> DataFrame:
    """Of each query and source the unlinked targets that agree best: country, name similarity, id, all falling.

    Both sides are bounded by parameters: the chosen queries, and the pool with their positives.
    """
    q = queries.select(F.col("entity_id").alias("qid"), explorer_normal("business_name").alias("qn"), explorer_normal("country").alias("qc"))
    t = pool.select(F.col("entity_id").alias("tid"), "source", explorer_normal("business_name").alias("tn"), explorer_normal("country").alias("tc"))
    wide = t.join(F.broadcast(q)).join(truth.select("qid", "tid"), ["qid", "tid"], "left_anti")
    scored = wide.select("qid", "tid", "source", (F.col("qc") == F.col("tc")).alias("same_country"), sequence_ratio("qn", "tn").alias("similarity"))
    return top_per_group(scored, ["qid", "source"], [F.desc("same_country"), F.desc("similarity"), F.desc("tid")], per_source, "_n").drop("_n")


def snapshot(sources: DataFrame, truth_lists: DataFrame, most: int, seed: int, synthetic: bool) -> dict:
    """Metadata and examples; at most `most` references reach the driver."""
    validate.require(validate.wrong_prefix(sources), "wrong id prefix")
    queries = cut(chosen_queries(sources.where("source = 1"), most, seed).select(*RECORD_FIELDS))
    lists = truth_lists.join(queries.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    validate.require(validate.duplicate_ids(lists, "source1_entity_id"), "duplicate truth row")
    validate.require(queries.join(lists, F.col("entity_id") == F.col("source1_entity_id"), "left_anti"), "no truth row")
    truth = cut(explode_truth(lists))
    targets = sources.where("source > 1").select("source", *RECORD_FIELDS)
    positives = truth.select(F.col("tid").alias("entity_id")).distinct()
    linked = cut(targets.join(positives, "entity_id", "left_semi"))
    validate.require(validate.duplicate_ids(linked, "entity_id"), "duplicate positive target")
    validate.require(positives.join(linked, "entity_id", "left_anti"), "positive target without a record")
    pool = cut(linked.unionByName(background(targets, positives, seed)))
    misses = near_misses(queries, pool, truth)
    record = F.struct(*RECORD_FIELDS).alias("target")
    named = pool.select(F.col("entity_id").alias("tid"), record)
    shown = truth.select("qid", "tid", F.substring("tid", 2, 1).cast("int").alias("source"), F.lit(True).alias("is_match"), F.lit(0.0).alias("order")).unionByName(
        misses.select("qid", "tid", "source", F.lit(False).alias("is_match"), (-F.col("similarity")).alias("order"))
    )
    rows = shown.join(named, "tid").groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((~F.col("is_match")).alias("a"), F.when(F.col("is_match"), 0).otherwise(F.col("source")).alias("b"), "order", "tid", "target", "source", "is_match"))), lambda x: F.struct(x["target"].alias("target"), x["source"].alias("source"), x["is_match"].alias("is_match"))).alias("comparisons")
    )
    counts = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    full = queries.withColumn("qid", F.col("entity_id")).join(rows, "qid", "left").join(counts, "qid", "left").orderBy("entity_id").collect()
    examples = [{"record": {f: r[f] for f in RECORD_FIELDS}, "match_count": r["n"] or 0, "comparisons": [{"target": c["target"].asDict(), "source": c["source"], "is_match": c["is_match"]} for c in r["comparisons"] or []]} for r in full]
    sizes = {str(r[0]): r[1] for r in targets.groupBy("source").count().collect()}
    return {
        "metadata": {"synthetic": synthetic, "generated_at": datetime.now(timezone.utc).isoformat(), "reference_count": len(examples), "true_links": sum(e["match_count"] for e in examples), "singletons": sum(not e["match_count"] for e in examples), "countries": sorted({e["record"]["country"] for e in examples}), "target_source_counts": sizes},
        "examples": examples,
    }


def export(spark: SparkSession, data_dir: str, output: str, most: int = 100, seed: int = 42, synthetic: bool = True) -> dict:
    found = snapshot(read_sources(spark, data_dir, "train"), read_truth(spark, data_dir), most, seed, synthetic)
    Storage(spark).write_json(output, found)
    return found
