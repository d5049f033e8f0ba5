"""Synthetic three-source data that exercises scripts, gaps, singletons and distractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tsv import RECORD_FIELDS

# Texts of the generated records.
NAMES = ("Étoile bakery branch ", "श्री गणेश दुकान ")
STREET, HIGHWAY, AVENUE = " Rue du Marché", " Highway", " Avenue"
UNRELATED, FOREIGN = "Unrelated industrial shop ", "Foreign corporation "


def fixture_records(spark: SparkSession, mode: str, n: int = 100) -> DataFrame:
    """source and the four record fields; 80 % of the references have an aligned twin in both targets."""
    i = F.col("id")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    number = F.lpad(i.cast("string"), 4, "0")
    country = F.lit("France") if mode == "test" else F.when(i % 2 == 1, "India").otherwise("US")
    name = F.when(i % 2 == 1, text(NAMES[1], i)).otherwise(text(NAMES[0], i))
    address = F.when(i % 11 == 0, "").otherwise(text(i + 200, STREET))
    base = spark.range(n)
    parts = [base.select(F.lit(1).alias("source"), text("S1-", number), name, address, country)]
    for s in (2, 3):
        linked = i % 5 != 0
        parts.append(base.select(F.lit(s), text(f"S{s}-", number), F.when(linked, name).otherwise(text(UNRELATED, i)), F.when(linked, address).otherwise(text(i + 9000, HIGHWAY)), country))
        parts.append(base.select(F.lit(s), text(f"S{s}-noise-", number), text(FOREIGN, i), text(i + 8000, AVENUE), country))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.toDF("source", *RECORD_FIELDS)


def fixture_truth(spark: SparkSession, n: int = 100) -> DataFrame:
    number = F.lpad(F.col("id").cast("string"), 4, "0")
    links = F.when(F.col("id") % 5 != 0, F.concat(F.lit("S2-"), number, F.lit(",S3-"), number)).otherwise("")
    return spark.range(n).select(F.concat(F.lit("S1-"), number).alias("source1_entity_id"), links.alias("matched_entity_ids"))


def write_fixture(spark: SparkSession, folder: str, n: int = 100) -> None:
    options = {"sep": "\t", "header": True, "emptyValue": ""}
    for mode in ("train", "test"):
        records = fixture_records(spark, mode, n)
        for s in (1, 2, 3):
            records.where(F.col("source") == s).drop("source").coalesce(1).write.mode("overwrite").options(**options).csv(f"{folder}/{mode}_source{s}.tsv")
    fixture_truth(spark, n).coalesce(1).write.mode("overwrite").options(**options).csv(f"{folder}/train_ground_truth.tsv")
