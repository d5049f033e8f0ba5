"""Constraint and containment checks. Each gives the offending rows; `require` raises on the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(violations: DataFrame, message: str) -> None:
    found = violations.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")


def duplicate_ids(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bad_ids(records: DataFrame, id_col: str) -> DataFrame:
    """Ids that are empty or hold a comma, tab or line end."""
    return records.where((F.coalesce(id_col, F.lit("")) == "") | F.col(id_col).rlike(r"[,\t\r\n]")).select(id_col)


def wrong_prefix(records: DataFrame, id_col: str = "entity_id") -> DataFrame:
    return records.where(~F.col(id_col).startswith(F.concat(F.lit("S"), F.col("source").cast("string"), F.lit("-")))).select(id_col, "source")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    return a.select(key).join(b.select(key), key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.select(key).join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def outside_candidates(accepted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Accepted pairs minus candidate pairs."""
    return accepted.select("qid", "tid").subtract(candidates.select("qid", "tid"))


def parse_list(column: Column) -> Column:
    """Ids of a comma list; an empty field is an empty list."""
    return F.when(F.coalesce(column, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))


def list_violations(lists: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, problem) of result lists: columns qid, candidates, matches (comma text); records (id, source).

    Problems: unknown_query, duplicate_query, bad_target_ids, unknown_target, outside_candidates.
    """
    rows = lists.select("qid", parse_list(F.col("candidates")).alias("c"), parse_list(F.col("matches")).alias("m"))
    sources = records.where("source = 1").select(F.col("id").alias("qid"))
    targets = records.where("source in (2, 3)").select(F.col("id").alias("tid"))
    tell = lambda df, problem: df.select("qid", F.lit(problem).alias("problem")).distinct()
    bad = lambda a: (F.size(a) != F.size(F.array_distinct(a))) | F.array_contains(a, "")
    listed = rows.select("qid", F.explode(F.array_union("c", "m")).alias("tid"))
    found = [
        tell(rows.join(sources, "qid", "left_anti"), "unknown_query"),
        tell(duplicate_ids(rows, "qid"), "duplicate_query"),
        tell(rows.where(bad(F.col("c")) | bad(F.col("m"))), "bad_target_ids"),
        tell(listed.where("tid <> ''").join(targets, "tid", "left_anti"), "unknown_target"),
        tell(rows.where(F.size(F.array_except("m", "c")) > 0), "outside_candidates"),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def uncovered(lists: DataFrame, records: DataFrame) -> DataFrame:
    """Source 1 records without a list, and lists without a record."""
    return symmetric_difference(records.where("source = 1").select(F.col("id").alias("qid")), lists, "qid")
