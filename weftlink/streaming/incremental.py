"""Incremental linkage: new reference files arrive as a stream and are matched against stored targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import hash_vectors, with_views
from ..operators.retrieval import dense_topk
from ..sources.tsv import RECORD_FIELDS

SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RECORD_FIELDS])


def match_batch(records: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Dense candidates of a batch of records. targets (tid, source, embedding)."""
    queries = hash_vectors(with_views(records.na.fill("")), "entity_id", "normalized").withColumnRenamed("entity_id", "qid")
    return dense_topk(queries, targets, k)


def match_stream(spark: SparkSession, folder: str, targets: DataFrame, output: str, checkpoint: str, k: int = 10) -> StreamingQuery:
    """Matches every file that appears in `folder` once; a batch overwrites its own folder, so a replay changes nothing."""
    arriving = spark.readStream.schema(SCHEMA).options(sep="\t", header=True, quote='"', escape='"').csv(folder)

    def write(batch: DataFrame, number: int) -> None:
        match_batch(batch, targets, k).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
