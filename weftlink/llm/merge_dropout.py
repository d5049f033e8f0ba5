"""SentencePiece encoding and decoding with seeded merge-dropout (operator 7).

Encoding keeps an agenda of adjacent symbols whose concatenation is a piece, best score first, leftmost of
equals. A candidate that comes up is skipped with probability `dropout`, which a keyed hash of the seed,
the row's key, its place in the text and the piece decides; so a seed gives one segmentation, another seed another,
and dropout 0 the standard one. No piece crosses from a word into the blanks after it, so each run of blanks with
its word has an agenda of its own.

Decoding gives back every text: blanks are written as U+2581, a U+2581 of the text itself and
characters outside the vocabulary as byte pieces. Defined results: null, empty texts have no ids and decode to
the empty text; very long words take memory in proportion; equal rows with equal keys are encoded alike; an empty table
gives no rows; a null key counts as the empty key.
"""

from __future__ import annotations

import re
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import table

BLANK = "\u2581"
SHIELD = "\ud800"  # stands for a U+2581 of the text: a lone surrogate, which no valid text holds
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_models: dict = {}


class MergeModel:
    """Pieces of a BPE model with byte fallback and the plain normaliser."""

    def __init__(self, path: str, cached: int = 200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.bytes = [0] * 256
        self.rank: dict[str, tuple[float, int]] = {}
        self.value: dict[int, int] = {}
        for k, piece in enumerate(self.pieces):
            if model.is_byte(k):
                self.value[k] = int(piece[3:5], 16)
                self.bytes[self.value[k]] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.rank[piece] = (-model.get_score(k), k)
        if any(BLANK in p.lstrip(BLANK) for p in self.rank):
            raise ValueError("a piece crosses words")
        if len(self.value) != 256:
            raise ValueError("no byte fallback")
        self.plain: dict[str, list[int]] = {}
        self.cached = cached

    @staticmethod
    def of(path: str) -> MergeModel:
        if path not in _models:
            _models[path] = MergeModel(path)
        return _models[path]

    def _single(self, symbol: str) -> list[int]:
        """Ids of a symbol: its piece, or the bytes of its characters."""
        found = self.rank.get(symbol)
        if found is not None:
            return [found[1]]
        return [self.bytes[b] for c in symbol for b in (BLANK if c == SHIELD else c).encode("utf-8", "replace")]

    def _merge(self, chunk: str, skip) -> list[int]:
        """Agenda over a chunk. `skip(place, piece id)` tells whether a candidate is dropped."""
        rank = self.rank
        symbols: list[str] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for k in range(n - 1):
            both = rank.get(symbols[k] + symbols[k + 1])
            if both is not None:
                agenda.append((both[0], k, k + 1, both[1], len(symbols[k]) + len(symbols[k + 1])))
        heapify(agenda)
        while agenda:
            _, left, right, piece, size = heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size or after[left] != right:
                continue
            if skip is not None and skip(left, piece):
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if 0 <= a and b < n:
                    both = rank.get(symbols[a] + symbols[b])
                    if both is not None:
                        heappush(agenda, (both[0], a, b, both[1], len(symbols[a]) + len(symbols[b])))
        return [i for s in symbols if s for i in self._single(s)]

    def encode(self, text: str | None, dropout: float = 0.0, seed: int = 0, key: str = "") -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        marked = BLANK + text.replace(BLANK, SHIELD).replace(" ", BLANK)
        if not dropout:
            if len(self.plain) > self.cached:
                self.plain.clear()
            for chunk in _CHUNK.findall(marked):
                found = self.plain.get(chunk)
                if found is None:
                    found = self.plain[chunk] = self._merge(chunk, None)
                ids += found
            return ids
        base = xxhash.xxh64_intdigest(f"{seed}\x1f{key}".encode("utf-8", "replace"))
        limit = int(dropout * (1 << 64))
        hashed = xxhash.xxh64_intdigest
        for m in _CHUNK.finditer(marked):
            at = m.start()

            def skip(place: int, piece: int) -> bool:
                return hashed(((at + place) << 32 | piece).to_bytes(16, "little"), base) < limit

            ids += self._merge(m[0], skip)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Inverse of `encode`, whatever the segmentation."""
        out, raw = [], bytearray()
        for k in ids:
            b = self.value.get(k)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[k].replace(BLANK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:]


_RESULT = [
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
]


def encode(rows: DataFrame, model: str, *, key_cols: list[str], text_col: str = "text", dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """key columns, text and ids of every row. A key column named `text` or `ids` could not be told from the result's own."""
    clash = {c.lower() for c in key_cols} & {"text", "ids"}
    if clash:
        raise ValueError(f"rename the key columns {sorted(clash)}")
    source = rows.select(*key_cols, F.col(text_col).cast("string").alias("_text"), F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]).alias("_key"))
    schema = T.StructType([*(source.schema[c] for c in key_cols), T.StructField("text", T.StringType()), _RESULT[0]])

    def run(batches):
        arrow, pieces = to_arrow_schema(schema), MergeModel.of(model)
        for batch in batches:
            texts, keys = batch.column(len(key_cols)), batch.column(len(key_cols) + 1).to_pylist()
            for k in range(0, batch.num_rows, 256):
                part = texts.slice(k, 256)
                ids = [pieces.encode(t, dropout, seed, key) for t, key in zip(part.to_pylist(), keys[k : k + 256])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 256) for c in range(len(key_cols))), part, pa.array(ids, arrow.field("ids").type)], schema=arrow)

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, *, ids_col: str = "ids") -> DataFrame:
    """All columns, and the decoded text in place of any column of that name."""
    base = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() != "decoded"])
    at = base.columns.index(ids_col)
    schema = T.StructType([*base.schema.fields, _RESULT[1]])

    def run(batches):
        arrow, pieces = to_arrow_schema(schema), MergeModel.of(model)
        for batch in batches:
            texts = [pieces.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=arrow)

    return base.mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(encoded: DataFrame) -> DataFrame:
    """Number and crc32 of the ids in place of the ids, and whether decoding gave the text back."""
    kept = [c for c in encoded.columns if c not in ("ids", "text", "decoded")]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            ids = [np.array(x or [], "<u4") for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            same = [(a or "") == b for a, b in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("decoded")).to_pylist())]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())], schema=arrow)

    return encoded.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn, segmented with dropout 0.1 under one seed and decoded again."""
    model = vocabulary()
    turns = table(spark, sf_dir, "conversations")
    return digest(decode(encode(turns, model, key_cols=["conv_id", "turn"], dropout=0.1, seed=17), model))


DECODED_SQL = "SELECT conv_id, turn, coalesce(text, '') AS decoded FROM conversations"


def decoded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of `op7_sentencepiece` that SQL can state: what decoding gives back."""
    model = vocabulary()
    return decode(encode(table(spark, sf_dir, "conversations"), model, key_cols=["conv_id", "turn"], dropout=0.1, seed=17), model).select("conv_id", "turn", "decoded")
