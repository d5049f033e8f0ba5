"""Row-wise numpy operators over Arrow batches, and bounded labelled samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textkernel import Slice, slices


#: Rows of whole texts that go to Python at once.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """Has Spark hand rows to Python in batches of at most BATCH_ROWS, here and later in the session, unless it does already.

    Spark's own 10,000 make buffers of some 30 MB out of whole texts, several of them for each task, outside the heap.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def release_memory() -> None:
    """Gives memory that is free, but still held by Arrow or the C library, back to the system; workers and drivers live long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files that nothing refers to any more.

    Between the phases of a long operator: left to chance, the files of all phases stand on disk together.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def project(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs; the text as a string."""
    return small_batches(df).select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), *more)


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, lengthened until no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append(df: DataFrame, text_col: str, fields: list[T.StructField], compute: Callable[[Slice], list], only_true: str | None = None) -> DataFrame:
    """`df` with columns that `compute` derives from each slice of whole texts.

    A column of the input that has the name of a new one is replaced. With `only_true`, rows are kept
    where that new boolean column holds, and the new columns are left out.
    """
    new = {f.name.lower() for f in fields}
    small_batches(df)
    base = df if only_true else df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    at = base.columns.index(text_col)
    schema = base.schema if only_true else T.StructType([*base.schema.fields, *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(at)):
                rows = batch.slice(part.first, part.n)
                found = dict(zip((f.name for f in fields), compute(part)))
                if only_true:
                    yield rows.filter(pa.array(found[only_true], pa.bool_()))
                else:
                    extra = [pa.array(found[f.name], arrow.field(f.name).type) for f in fields]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *extra], schema=arrow)

    return base.mapInArrow(run, schema)


#: Rows of a few numbers that may go to every task: some 40 MB at most.
BROADCAST_ROWS = 500_000


def small(keys: DataFrame) -> DataFrame:
    """Marks stored `keys` for broadcast if they are at most BROADCAST_ROWS; beyond that a join shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> DataFrame:
    """At most `per_class` labelled ids of either class (0, 1), by a hash of the id; other labels are ignored."""
    use = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull())
    pick = lambda v: use.where(F.col("label") == v).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
    return pick(0).unionByName(pick(1))
