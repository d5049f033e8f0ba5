"""Best-fit packing (operator 9) of tokenized documents into sequences of bounded length.

Each task tokenizes its documents, cuts those longer than a sequence, and packs the pieces best-fit in
falling order of size. Nearly full bins are final; the others become the items of the next round, dealt to
fewer tasks, until one task holds all that is left. No task holds more than `bins_per_task` bins, and a bin
holds at most `capacity` pieces.

Best-fit leaves a task at most one bin that is half full or less, and no two of its bins fit together. So once a
round of several tasks saves next to nothing, only those few small bins can still save one, each by joining
another small bin or one with room: all small bins and as many of the roomiest others go on, which is
all that any later round could use, and the rest is final.

Tokenization splits at the tokenizer's special tokens and at ASCII white space first, which its own split never
crosses, and keeps what it found for a word. Defined results: null and empty texts are the end token alone; equal rows are
packed one by one; an empty table gives no rows; a null id is packed and stays null.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, table
from .frames import project
from .textkernel import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CAPACITY = 4096
END = 1
CACHED_WORDS = 1_500_000  # of a worker, about 200 bytes each; fewer cost time alone
STUCK = 0.98  # share of bins left from which a round of several tasks counts as having saved next to nothing
_TRAIL = b".,;:!?&$%*#"
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_chars() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte: itself, or the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()

PIECE = np.dtype([("doc_id", "<i8"), ("known", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
_BIN = T.StructType([T.StructField("load", T.IntegerType()), T.StructField("pieces", T.BinaryType()), T.StructField("sequence_id", T.LongType())])
_ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset"))])

_tokenizers: dict = {}


class WordTokenizer:
    """Ids of a text as little-endian bytes, word by word with a bounded store of words."""

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        # special tokens count as written, before any normal form; words that become equal to one by that do not
        self.special = {t.content.encode(): k.to_bytes(4, "little") for k, t in self.inner.get_added_tokens_decoder().items()}
        self.marks = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.inner.encode_special_tokens = True
        # words of plain small letters need no normal form and no split, only the model
        self.letters = Tokenizer(self.inner.model)
        self.known: dict[bytes, bytes] = {}
        self.limit = limit

    @staticmethod
    def of(path: str, limit: int) -> WordTokenizer:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        _tokenizers[path].limit = limit
        return _tokenizers[path]

    @staticmethod
    def _lower(text: bytes) -> bytes:
        """Lower case where that commutes with the tokenizer's normal form: no combining mark can follow."""
        return text if b"\xcc" in text or b"\xcd" in text else text.lower()

    @staticmethod
    def _stem(word: bytes) -> bytes:
        """The word without a closing run of marks, where the tokenizer splits them off a letter or digit."""
        stem = word.rstrip(_TRAIL)
        if stem == word or not stem:
            return word
        last = stem[-1:]
        accented = stem[-2:-1] == b"\xc3" and 0xA0 <= stem[-1] and stem[-1] != 0xB7
        return stem if last.isalnum() or accented else word

    def _learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if _SMALL.fullmatch(w)]
        rest = list(set(words).difference(plain))
        self._encode(self.letters, plain, [w.decode("latin-1").translate(_BYTE_CHARS) for w in plain])
        self._encode(self.inner, rest, [w.decode("utf-8", "replace") for w in rest])

    def _encode(self, tokenizer, words: list[bytes], texts: list[str]) -> None:
        for k in range(0, len(words), 20_000):
            found = tokenizer.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)
            self.known.update(zip(words[k : k + 20_000], (array("I", e.ids).tobytes() for e in found)))

    def _words(self, text: bytes) -> list[bytes]:
        """Lower-cased words; a special token with a blank after it, which no word has."""
        if self.marks is None or not self.marks.search(text):
            return self._lower(text).split()
        parts = self.marks.split(text)
        return [w for k, part in enumerate(parts) for w in ([part + b" "] if k % 2 else self._lower(part).split())]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = list(map(self._words, texts))
        known = self.known
        if len(known) > self.limit:
            known.clear()
        known.update((content + b" ", number) for content, number in self.special.items())
        missing = list(set().union(*split).difference(known))
        stems = list(map(self._stem, missing))
        rest = [w[len(s) :] for w, s in zip(missing, stems)]
        self._learn(list(set(stems).union(rest).difference(known, (b"",))))
        known.update((w, known[s] + known[r]) for w, s, r in zip(missing, stems, rest) if r)
        return [b"".join(map(known.__getitem__, words)) for words in split]


def cut_document(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces of a document whose ids are given as bytes."""
    ids += END.to_bytes(4, "little")
    width = 4 * capacity
    return [(k // width, k // 4, (min(len(ids), k + width) - k) // 4, zlib.crc32(ids[k : k + width])) for k in range(0, len(ids), width)]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of item positions: items in falling order, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        room -= size
        by_room[room].append(at)
        rooms |= 1 << room
    return bins


def _bins(sizes: np.ndarray, members: list[bytes], capacity: int, level: int) -> pa.RecordBatch:
    packed = best_fit(sizes, capacity)
    base = (level << 56) + (TaskContext.get().partitionId() << 28)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(sizes[b].sum()) for b in packed], pa.int32()),
            pa.array([b"".join(members[k] for k in b) for b in packed], pa.binary()),
            pa.array(range(base, base + len(packed)), pa.int64()),
        ],
        schema=to_arrow_schema(_BIN),
    )


def _first_round(batches, path: str, capacity: int, items_per_task: int, cached_words: int):
    tokenizer = WordTokenizer.of(path, cached_words)
    pieces: list[tuple] = []
    made = 0

    def pack() -> pa.RecordBatch:
        rows = np.array(pieces, PIECE)
        return _bins(rows["length"].astype(np.int64), [r.tobytes() for r in rows], capacity, 0)

    for batch in batches:
        for part in slices(batch.column(1), 1 << 20):
            ids = batch.column(0).slice(part.first, part.n).to_pylist()
            raw = part.data.tobytes()
            texts = [raw[a:b] for a, b in zip(part.rows[:-1].tolist(), part.rows[1:].tolist())]
            for doc_id, found in zip(ids, tokenizer.encode(texts)):
                for piece, start, length, crc in cut_document(found, capacity):
                    pieces.append((0 if doc_id is None else doc_id, doc_id is not None, piece, start, length, crc))
            if len(pieces) >= items_per_task:
                yield _renumbered(pack(), made)
                made += len(pieces)
                pieces.clear()
    if pieces:
        yield _renumbered(pack(), made)


def _renumbered(bins: pa.RecordBatch, by: int) -> pa.RecordBatch:
    return bins.set_column(2, "sequence_id", pa.array(bins.column(2).to_numpy() + by, pa.int64())) if by else bins


def _next_round(batches, capacity: int, level: int):
    got = [b for b in batches if b.num_rows]
    if got:
        every = pa.Table.from_batches(got).combine_chunks()
        yield _bins(every["load"].to_numpy().astype(np.int64), every["pieces"].to_pylist(), capacity, level)


def _unfold(batches):
    schema = to_arrow_schema(_ROW)
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column(0).to_pylist()
        rows = np.frombuffer(b"".join(raw), PIECE)
        counts = np.array([len(r) // PIECE.itemsize for r in raw])
        ends = np.cumsum(rows["length"], dtype=np.int64)
        before = ends - rows["length"]
        firsts = np.cumsum(counts) - counts
        offset = before - np.repeat(before[firsts], counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows["doc_id"], mask=~rows["known"]), pa.array(rows["piece"]), pa.array(rows["start"]), pa.array(rows["length"].astype(np.int64)),
                pa.array(rows["crc"].astype(np.int64)), pa.array(np.repeat(batch.column(1).to_numpy(), counts)), pa.array(offset),
            ],
            schema=schema,
        )


def pack(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         nearly_full: float = 0.97, bins_per_task: int = 20_000, cached_words: int = CACHED_WORDS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Ids are cast to long: one of another type that names no integer is packed under a null id or fails the
    query, as the session's ANSI mode has it.
    """
    if bins_per_task < 8:
        raise ValueError("a round needs 8 bins a task to come to an end")
    source = project(documents.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    full_at = int(nearly_full * capacity)
    bins = cut(source.mapInArrow(lambda b: _first_round(b, tokenizer, capacity, 10 * bins_per_task, cached_words), _BIN))
    done = bins.where(F.col("load") >= full_at)
    rest = bins.where(F.col("load") < full_at)
    left, level = rest.count(), 0
    while left:
        level += 1
        tasks = -(-left // bins_per_task)
        packed = cut(rest.repartition(tasks).mapInArrow(lambda b, level=level: _next_round(b, capacity, level), _BIN))
        if tasks == 1:
            done = done.unionByName(packed)
            break
        goes_on = F.col("load") < full_at
        now = packed.where(goes_on).count()
        if now > STUCK * left:
            small = F.col("load") <= capacity // 2
            count = packed.where(small).count()  # one a task at most
            place = F.struct("load", "sequence_id")
            last = packed.where(goes_on & ~small).orderBy("load", "sequence_id").limit(count).agg(F.max(place)).first()[0]
            goes_on = small | (place <= F.struct(F.lit(last[0]).cast("int"), F.lit(last[1]).cast("long"))) if last else small
            now = packed.where(goes_on).count()
        done, rest, left = done.unionByName(packed.where(~goes_on)), packed.where(goes_on), now
    return done.select("pieces", "sequence_id").mapInArrow(_unfold, _ROW).withColumnsRenamed({"doc_id": id_col})


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
