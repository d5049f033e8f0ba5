"""Compressed approximate inner-product search: coarse cells and product-quantised vectors."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut
from .blocks import block_join
from .retrieval import DIGITS, TILE, _best, by_id, dense_topk, found_schema, gathered, matrix, per_source, ranked

CELL_BLOCK = (1024, 1 << 15)  # queries that probe a cell and vectors in it that meet in a task
_STEP = 8192


def subspaces(dimension: int, most: int) -> int:
    """Largest divisor of the dimension up to `most`."""
    return max(m for m in range(1, most + 1) if dimension % m == 0)


def lists(targets: int, most: int) -> int:
    return min(most, max(1, targets // 40))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = (centres**2).sum(axis=1)
    return np.concatenate([np.argmin(own - 2 * x[k : k + _STEP] @ centres.T, axis=1) for k in range(0, len(x), _STEP)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Quantizer:
    """Cells and codebooks fitted on a bounded sample; every vector is then assigned and coded."""

    def __init__(self, cells: np.ndarray, books: np.ndarray):
        self.cells, self.books, self.m = cells, books, len(books)

    @staticmethod
    def fit(sample: np.ndarray, n: int, *, ivf_nlist: int = 1024, pq_m: int = 32, seed: int = 42) -> Quantizer:
        if len(sample) < 256:
            raise ValueError("a codebook of 256 needs as many training vectors")
        rng = np.random.default_rng(seed)
        cells = _kmeans(sample, lists(n, ivf_nlist), 12, rng)
        rest = sample - cells[_nearest(sample, cells)]
        parts = np.split(rest, subspaces(sample.shape[1], pq_m), axis=1)
        return Quantizer(cells, np.stack([_kmeans(part, 256, 8, rng) for part in parts]))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.cells)
        parts = np.split(x - self.cells[cell], self.m, axis=1)
        return cell, np.stack([_nearest(p, b) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)

    def probes(self, queries: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells of each query by inner product, and those products."""
        coarse = queries @ self.cells.T
        near = np.argsort(-coarse, axis=1, kind="stable")[:, :nprobe]
        return near, np.take_along_axis(coarse, near, axis=1)

    def scores(self, queries: np.ndarray, coarse: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products with coded vectors of one cell, from lookup tables; `coarse` are those with the cell's centre."""
        total = np.repeat(coarse[:, None], len(codes), axis=1)
        for k, part in enumerate(np.split(queries, self.m, axis=1)):
            total += (part @ self.books[k].T)[:, codes[:, k]]
        return total


class IvfPq:
    """Compressed index: a quantizer for each source, and every target's code under its source and cell."""

    def __init__(self, models: dict[int, Quantizer], codes: DataFrame):
        self.models, self.codes = models, codes

    @staticmethod
    def build(targets: DataFrame, *, ivf_nlist: int = 1024, pq_m: int = 32, train_rows: int = 200_000, seed: int = 42, path: str | None = None) -> IvfPq:
        """Fits on a hash sample of at most `train_rows` vectors a source, which bounds what reaches the driver, and codes
        every target once. With `path` the index is stored there, for `open`."""
        use = targets.select("tid", F.col("source").cast("int").alias("source"), "embedding").where("embedding is not null")
        models = {}
        for source, n in sorted((r[0], r[1]) for r in use.groupBy("source").count().collect()):
            rows = use.where(F.col("source") == source).orderBy(F.xxhash64("tid"), "tid").limit(train_rows).select("embedding").toPandas()
            models[source] = Quantizer.fit(np.array(rows["embedding"].tolist(), float), n, ivf_nlist=ivf_nlist, pq_m=pq_m, seed=seed)
        shared = targets.sparkSession.sparkContext.broadcast(models)
        schema = T.StructType([use.schema["tid"], use.schema["source"], T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])

        def run(batches):
            arrow = to_arrow_schema(schema)
            for batch in batches:
                vectors, sources = matrix(pa.table(batch.columns, names=["tid", "source", "embedding"]), "embedding"), batch.column(1).to_numpy()
                cell, code = np.zeros(len(vectors), np.int32), [b""] * len(vectors)
                for source in np.unique(sources):
                    at = np.flatnonzero(sources == source)
                    cell[at], own = shared.value[int(source)].encode(vectors[at])
                    for k, c in zip(at.tolist(), own):
                        code[k] = c.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(code, pa.binary())], schema=arrow)

        codes = use.mapInArrow(run, schema)
        if path is None:
            return IvfPq(models, cut(codes))
        codes.repartitionByRange("source", "cell").sortWithinPartitions("source", "cell", "tid").write.mode("overwrite").parquet(f"{path}/codes")
        rows = [(s, m.m, m.cells.shape[1], m.cells.tobytes(), m.books.tobytes()) for s, m in models.items()]
        spark = targets.sparkSession
        spark.createDataFrame(rows, "source int, m int, dimension int, cells binary, books binary").write.mode("overwrite").parquet(f"{path}/models")
        return IvfPq.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> IvfPq:
        models = {}
        for r in spark.read.parquet(f"{path}/models").collect():  # one row for each source, of bounded size
            books = np.frombuffer(bytes(r.books), float).reshape(r.m, 256, r.dimension // r.m)
            models[r.source] = Quantizer(np.frombuffer(bytes(r.cells), float).reshape(-1, r.dimension), books)
        return IvfPq(models, spark.read.parquet(f"{path}/codes"))

    def search(self, queries: DataFrame, k: int, nprobe: int = 32) -> DataFrame:
        """As `dense_topk`, approximately: queries travel to their `nprobe` best cells and meet the codes there.

        Fewer than k rows come back where those cells hold fewer.
        """
        shared, schema = queries.sparkSession.sparkContext.broadcast(self.models), found_schema(queries, self.codes, "dense_score")
        asked = per_source(queries.select("qid", "embedding").where("embedding is not null"), self.codes)
        routed = T.StructType([asked.schema["qid"], asked.schema["source"], T.StructField("cell", T.IntegerType()), T.StructField("coarse", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])

        def route(batches):
            arrow = to_arrow_schema(routed)
            for batch in batches:
                rows = pa.table(batch.columns, names=["qid", "embedding", "source"])
                vectors, sources = matrix(rows, "embedding"), batch.column(2).to_numpy()
                for source in np.unique(sources):
                    at = np.flatnonzero(sources == source)
                    near, coarse = shared.value[int(source)].probes(vectors[at], nprobe)
                    row = np.repeat(at, near.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), source, np.int32)), pa.array(near.ravel().astype(np.int32)), pa.array(coarse.ravel()), pa.array(list(vectors[row]), arrow.field("vector").type)], schema=arrow)

        def search(q: pa.Table, t: pa.Table) -> dict:
            t = by_id(t, "tid")
            model = shared.value[t["source"][0].as_py()]
            codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            vectors, coarse, parts = matrix(q, "vector"), q["coarse"].to_numpy(), []
            step = max(1, TILE // t.num_rows)
            for first in range(0, q.num_rows, step):
                scores = np.round(model.scores(vectors[first : first + step], coarse[first : first + step], codes), DIGITS)
                row, place = _best(scores, k)
                parts.append((first + row, place, scores[row, place]))
            return gathered(q, t, "dense_score", parts)

        found = block_join(asked.mapInArrow(route, routed), self.codes, ["source", "cell"], search, schema, query_rows=CELL_BLOCK[0], target_rows=CELL_BLOCK[1])
        return ranked(found, k, "dense_score", "dense_rank")


def ivfpq_topk(queries: DataFrame, targets: DataFrame, k: int, *, nprobe: int = 32, **options) -> DataFrame:
    return IvfPq.build(targets, **options).search(queries, k, nprobe)


def dense_channel(queries: DataFrame, targets: DataFrame, k: int, *, exact_limit: int = 50_000, **options) -> DataFrame:
    """Exact up to `exact_limit` targets in a source, compressed beyond; a `path` among the options keeps the index."""
    most = targets.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    return dense_topk(queries, targets, k) if most <= exact_limit else ivfpq_topk(queries, targets, k, **options)


def channel(**options):
    """`dense_channel` with its options bound, for `retrieve`."""
    return partial(dense_channel, **options)
