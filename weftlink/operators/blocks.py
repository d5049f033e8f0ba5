"""Joins of a stated query set with all targets, block by block.

Where the keys are few and blocks many (sources), rows are packed into blocks once and every block of queries meets every
block of targets by `meet`, which reads stored blocks again and again and writes none. Where a query meets few of many keys (cells of an
index), `block_join` deals the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, spread

MEETS = 4  # blocks of targets that a task of `meet` goes through at least, if there are enough tasks
STREAMS = 2  # tasks over which the targets of a block of queries are dealt at most, if there are enough tasks
MERGE_ROWS = 1 << 18
LEAST_ROWS = 64  # a block is not split below that for the sake of more tasks


def block_join(queries: DataFrame, targets: DataFrame, on: list[str], search: Callable[[pa.Table, pa.Table], dict], schema: T.StructType, *, query_rows: int, target_rows: int) -> DataFrame:
    """What `search` finds for each block of queries and each block of targets that have the same key `on`.

    queries hold qid, targets tid. Both sides of a key are dealt by a hash of the id into blocks of about `query_rows` and
    `target_rows`, so a key may hold any share of the rows. A row travels once for each block it meets and none passes
    the driver. Keys must be few by some parameter (sources, cells of an index): their sizes are broadcast.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    count = F.count(F.lit(1))
    sizes = cut(queries.groupBy(*on).agg(count.alias("_nq")).join(targets.groupBy(*on).agg(count.alias("_nt")), on))
    blocks = sizes.select(*on, "_nt", F.ceil(F.col("_nq") / query_rows).alias("_qs"), F.ceil(F.col("_nt") / target_rows).alias("_ts"))
    cells = blocks.agg(F.sum(F.col("_qs") * F.col("_ts"))).first()[0] or 1
    finer = -(-2 * cores // cells)
    blocks = blocks.withColumn("_ts", F.greatest("_ts", F.least(F.col("_ts") * finer, F.ceil(F.col("_nt") / LEAST_ROWS)))).drop("_nt")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    left = queries.join(F.broadcast(blocks), on).withColumn("_q", dealt("qid", "_qs")).withColumn("_t", upto("_ts")).drop("_qs", "_ts")
    right = targets.join(F.broadcast(blocks), on).withColumn("_t", dealt("tid", "_ts")).withColumn("_q", upto("_qs")).drop("_qs", "_ts")
    keys, arrow = [*on, "_q", "_t"], to_arrow_schema(schema)
    tasks = min(max(cells * finer, 1), 20_000)

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        found = search(q.combine_chunks(), t.combine_chunks()) if q.num_rows and t.num_rows else None
        return arrow.empty_table() if found is None else pa.table([found[f.name].cast(f.type) for f in arrow], schema=arrow)

    # fresh names: both sides may come from one table, whose columns a cogroup could not tell apart
    sides = (df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(tasks, *keys).groupBy(*keys) for df in (left, right))
    return next(sides).cogroup(next(sides)).applyInArrow(run, schema)


def to_bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def pack(rows: DataFrame, id_col: str, block_rows: int, make: Callable[[pa.Table], pa.Table] = lambda t: t, more: dict[str, tuple] | None = None) -> DataFrame:
    """Stored blocks (block, source, n, data) of at most `block_rows` rows of one source, in order of the id.

    rows (id, source, ...) in any order; `make` turns a table of them into what a block keeps. `more` names
    columns beside the data: a type and a function of that table. A row lies in one block, none passes the driver.
    """
    more = more or {}
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, rows.select(id_col).count()
    rows, goal = spread(rows), max(cores, -(-n // block_rows))
    rows = rows.coalesce(goal) if rows.rdd.getNumPartitions() > goal else rows
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("source", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType()), *(T.StructField(c, kind) for c, (kind, _) in more.items())])
    arrow, names = to_arrow_schema(schema), rows.columns

    def run(batches):
        at, held, sizes = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, {}, {}

        def block(source):
            nonlocal at
            whole = pa.concat_tables(held.pop(source)).sort_by(id_col)
            sizes.pop(source)
            found = make(whole)
            at += 1
            cells = [at, source, whole.num_rows, to_bytes(found), *(f(found) for _, f in more.values())]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow)], schema=arrow)

        for batch in batches:
            table = pa.table(batch.columns, names=names)
            sources = table["source"].to_numpy()
            for source in set(sources.tolist()):
                own = table.filter(pa.array(sources == source))
                while own.num_rows:
                    part = own.slice(0, block_rows - sizes.get(source, 0))
                    own = own.slice(part.num_rows)
                    held.setdefault(source, []).append(part)
                    sizes[source] = sizes.get(source, 0) + part.num_rows
                    if sizes[source] == block_rows:
                        yield block(source)
        for source in list(held):
            yield block(source)

    return cut(rows.mapInArrow(run, schema))


def best_rows(found: list[pa.Table], k: int | None, score: str) -> list[pa.Table]:
    """The k rows of each query and source with the highest score, ties by the smaller target; all of them without k."""
    rows = pa.concat_tables(found)
    if k is None or not rows.num_rows:
        return [rows]
    rows = rows.sort_by([("qid", "ascending"), ("source", "ascending"), (score, "descending"), ("tid", "ascending")])
    keys = pa.table({"key": pa.StructArray.from_arrays([rows[c].combine_chunks() for c in ("qid", "source")], ["q", "s"])})["key"].combine_chunks()
    q, s = keys.field(0), keys.field(1).to_numpy()
    q = q.dictionary_encode().indices.to_numpy()
    first = np.concatenate(([True], (q[1:] != q[:-1]) | (s[1:] != s[:-1])))
    starts = np.flatnonzero(first)
    place = np.arange(len(q)) - starts[np.cumsum(first) - 1]
    return [rows.filter(pa.array(place < k))]


def meet(queries: DataFrame, targets: DataFrame, search: Callable[..., dict | None], schema: T.StructType, k: int | None, score: str, carried: list[str] = ["data"]) -> DataFrame:  # noqa: B006
    """What `search(query cells, target cells, source)` finds for every stored block of queries and every one of targets.

    A Cartesian product of two tables of a few large cells: a task reads one partition of query blocks and streams one of target blocks past
    it, so nothing is shuffled and nothing but its k best of each query and source leaves it. Each stream sends k of its own, so there are
    few however many blocks of targets there are: what leaves the tasks follows the queries, not the pairs of blocks. `carried` are the
    columns that a query's cells have; a block's number comes first.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks, parts = targets.count(), queries.rdd.getNumPartitions()
    streams = max(1, min(STREAMS, -(-blocks // MEETS)), -(-2 * cores // max(1, parts)))
    left = targets.select(F.col("block").alias("_tb"), F.col("source").alias("_ts"), F.col("data").alias("_td")).coalesce(streams)
    right = queries.select(F.col("block").alias("_qb"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(carried)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        kept, n = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                cells = [batch.column(c)[row].as_py() for c in range(batch.num_columns)]
                found = search((cells[3], *cells[4:]), (cells[0], cells[2]), cells[1])
                if found is None:
                    continue
                kept.append(pa.table([found[f.name].cast(f.type) for f in arrow], schema=arrow))
                n += kept[-1].num_rows
                if k is not None and n > MERGE_ROWS:
                    kept = best_rows(kept, k, score)
                    n = -kept[0].num_rows
            if k is None and kept:
                yield from pa.concat_tables(kept).to_batches()
                kept = []
        if kept:
            yield from best_rows(kept, k, score)[0].to_batches()

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, schema)
