"""Encoders and pair scorers that can be plugged into the linkage plan, and the checks that their artifacts fit each other.

A model is a `meta` that describes it and a `load` that a worker calls once; what `load` returns maps a list of texts to
vectors, or lists of two texts to scores. No deep-learning library is needed here: whoever has one wraps it in `load`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import hash_vector, normalize_text, ratio

#: What two artifacts must agree in to be used together, if either names it.
BINDING = ("kind", "base", "format", "pooling", "normalized", "max_length", "dimension", "vocabulary_size")


@dataclass(frozen=True)
class Encoder:
    """Texts to vectors. `text_col` is the view it reads."""

    meta: dict
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    text_col: str = "raw"


@dataclass(frozen=True)
class PairScorer:
    """Two lists of texts to scores between 0 and 1."""

    meta: dict
    load: Callable[[], Callable[[list[str], list[str]], np.ndarray]] = field(repr=False)


def hash_encoder(dimension: int = 64) -> Encoder:
    """The deterministic encoder of signed trigram hashes."""
    return Encoder({"kind": "hash", "dimension": dimension, "normalized": True}, lambda: lambda texts: np.stack([hash_vector(t, dimension) for t in texts]), "normalized")


def ratio_scorer() -> PairScorer:
    """The deterministic scorer: sequence ratio of the normalized texts."""
    return PairScorer({"kind": "ratio"}, lambda: lambda a, b: np.array([ratio(normalize_text(x), normalize_text(y)) for x, y in zip(a, b)]))


def check_fit(found: dict, wanted: dict, what: str) -> None:
    """Raises where the descriptions of two artifacts differ in what binds them."""
    for name in BINDING:
        if (name in found or name in wanted) and found.get(name) != wanted.get(name):
            raise ValueError(f"{what}: {name} is {found.get(name)!r} in one and {wanted.get(name)!r} in the other")


def encode(records: DataFrame, encoder: Encoder, id_col: str, batch_rows: int = 256) -> DataFrame:
    """(id, embedding) of every record. Raises where a vector has another length than the encoder's description says."""
    base = records.select(id_col, F.coalesce(encoder.text_col, F.lit("")).alias("_text"))
    schema = T.StructType([base.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    load, dimension = encoder.load, encoder.meta.get("dimension")

    def run(batches):
        model = load()
        for batch in batches:
            for k in range(0, batch.num_rows, batch_rows):
                part = batch.slice(k, batch_rows)
                vectors = np.asarray(model(part.column(1).to_pylist()), np.float32)
                if vectors.ndim != 2 or len(vectors) != part.num_rows or dimension is not None and vectors.shape[1] != dimension:
                    raise ValueError(f"the encoder gave {vectors.shape} for {part.num_rows} texts of dimension {dimension}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return base.mapInArrow(run, schema)


def score_pairs(rows: DataFrame, scorer: PairScorer, a: str, b: str, name: str) -> DataFrame:
    """`rows` with the scorer's value for two text columns."""
    load = scorer.load

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for x, y in parts:
            yield pd.Series(np.asarray(model(x.fillna("").tolist(), y.fillna("").tolist()), float))

    return rows.withColumn(name, score(a, b))
