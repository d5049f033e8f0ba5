"""Deterministic hash samples, grouped splits and distractor pools."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("fit", "dev", "calibration", "audit")
SHARES = (0.7, 0.1, 0.1, 0.1)


def hash_rank(entity_id: str | Column, seed: int, salt: str) -> Column:
    """SHA-256 of the JSON list [seed, salt, id]."""
    column = F.col(entity_id) if isinstance(entity_id, str) else entity_id
    escaped = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.sha2(F.concat(F.lit(f'[{seed}, "{salt}", "'), escaped, F.lit('"]')), 256)


def sample_size(count: int, percent: float) -> int:
    if not 0 < percent <= 100:
        raise ValueError("percent must lie in (0, 100]")
    return math.ceil(count * percent / 100)


def select(ids: DataFrame, percent: float, seed: int, salt: str = "sample", id_col: str = "entity_id") -> DataFrame:
    """The ceil(count * percent / 100) rows with the smallest (hash rank, id).

    The cut is a rank that a distributed sort by range finds; no task or driver holds the ids.
    """
    size = sample_size(ids.count(), percent)
    return smallest(ids.withColumn("_rank", hash_rank(id_col, seed, salt)), size, "_rank", id_col).drop("_rank")


def smallest(rows: DataFrame, size: int, rank: str, tie: str) -> DataFrame:
    """The `size` smallest rows by (rank, tie)."""
    return with_position(rows, rank, tie).where(F.col("_position") < size).drop("_position")


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """0-based global position by `order`: a range sort, then partition offsets.

    Needs one count for each partition on the driver, not a single-partition window.
    """
    from ..session import cut

    ordered = cut(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("first")).orderBy("_part").collect()
    offsets, before = [], 0
    for c in counts:
        offsets.append((c["_part"], before - c["first"]))
        before += c["n"]
    if not offsets:
        return ordered.drop("_part").withColumnRenamed("_seq", "_position")
    shift = ordered.sparkSession.createDataFrame(offsets, "_part int, _shift long")
    # one row for each partition of the sort
    return ordered.join(F.broadcast(shift), "_part").withColumn("_position", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


def split_sizes(n: int) -> list[int]:
    """Whole parts of n * share; what is left goes to the largest fractions, earlier ones first."""
    exact = [n * s for s in SHARES]
    sizes = [int(x) for x in exact]
    for k in sorted(range(len(SHARES)), key=lambda k: sizes[k] - exact[k])[: n - sum(sizes)]:
        sizes[k] += 1
    return sizes


def split_groups(ids: DataFrame, seed: int, id_col: str = "entity_id") -> DataFrame:
    """ids with `split`: consecutive slices of the order by (hash rank, id)."""
    placed = with_position(ids.withColumn("_rank", hash_rank(id_col, seed, "split")), "_rank", id_col).drop("_rank")
    label, before = F.lit(SPLITS[-1]), 0
    bounds = []
    for name, size in zip(SPLITS, split_sizes(ids.count())):
        before += size
        bounds.append((name, before))
    for name, bound in reversed(bounds[:-1]):
        label = F.when(F.col("_position") < bound, F.lit(name)).otherwise(label)
    return placed.withColumn("split", label).drop("_position")


def distractors(targets: DataFrame, mandatory: DataFrame, percent: float, seed: int, salt: str, id_col: str = "entity_id") -> DataFrame:
    """Ids that must stay and a hash sample of the others."""
    must = mandatory.select(id_col).distinct()
    others = targets.select(id_col).join(must, id_col, "left_anti")
    return targets.select(id_col).join(must, id_col, "left_semi").unionByName(select(others, percent, seed, salt, id_col))


def calibration_halves(ids: DataFrame, seed: int, id_col: str = "entity_id") -> DataFrame:
    """ids with `half`: the first floor(n/2) by hash rank are probability, the others policy."""
    n = ids.count()
    if n < 2:
        raise ValueError("calibration needs two entities")
    placed = with_position(ids.withColumn("_rank", hash_rank(id_col, seed, "calibration-half")), "_rank", id_col)
    return placed.withColumn("half", F.when(F.col("_position") < n // 2, "probability").otherwise("policy")).drop("_rank", "_position")


def shuffle_order(seed: int, epoch: Column, qid: Column, tid: Column) -> Column:
    """Order key of a training epoch: SHA-256 of the JSON list [seed, epoch, qid, tid]."""
    return F.sha2(F.concat(F.lit(f"[{seed}, "), epoch.cast("string"), F.lit(', "'), qid, F.lit('", "'), tid, F.lit('"]')), 256)


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """1-based rank within keys, up to k; Spark limits each group before and after the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
