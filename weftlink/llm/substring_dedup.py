"""Substring dedup (operator 1) with a log-structured fingerprint index.

A window is `WINDOW` consecutive words of one document. A word goes when a window over it also starts in a
document with a smaller id. Documents come in batches of rising id; the index holds what earlier batches
left in immutable runs, bucketed and sorted by key. A batch is merge-joined with each run where the run lies, without
an exchange or a sort of it, before it appends its own; `fan_in` runs are compacted into one. `save` and `open` carry
an index from one job to the next.

Two kinds of run keep this linear. An *anchor* run maps the smallest hash among a window's inner
`GRAM`-word grams to the first document that has it: equal windows have equal anchors, and neighbours
mostly share theirs, so there is about one for 13 windows. A *window* run maps the 128-bit BLAKE2 digest
of a window's words to the first document that has it; only windows whose anchor occurs in two documents
enter, at the batch in which it first does, for the batch's documents and for the one earlier
document. Digests are taken from the words themselves, so they verify what the anchors propose; of earlier texts only those
are read again that an anchor of the batch points at for the first time.

Before windows are compared, consecutive ones with one anchor form a segment. Equal segments are grouped first: copies of
a passage meet as one row with the smallest id, and only the windows of distinct segments are dealt out.

Defined results: null, empty and short texts lose nothing; windows repeated only within one document
lose nothing; rows that repeat an id are judged one by one and don't remove each other; a row with a null
id is neither source nor target; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, drop_path, scratch, table
from ..storage import Storage
from .frames import BROADCAST_ROWS, append, project, small, small_batches, unused
from .textkernel import Slice, mix, slices

WINDOW = 50
GRAM = 25
_SPAN = WINDOW - GRAM + 1  # grams in a window, and most windows in a segment
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def window_anchors(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where a window starts in its row, and the anchor of each."""
    n = len(part.starts)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps, dtype=np.uint64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(part.word_hashes() * powers[0][:n], dtype=np.uint64, out=total[1:])
    least = mix((total[GRAM:] - total[:-GRAM]) * powers[1][: n - GRAM + 1])
    width = 1
    while width < _SPAN:
        step = min(width, _SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    row = part.word_row()
    at = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    return at, least[at]


def _segments(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and anchor of each segment."""
    at, anchor = window_anchors(part)
    if not len(at):
        return at, at, anchor
    row = np.searchsorted(part.word_rows, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    if length.max() > _SPAN:  # a gram that repeats every few words
        extra = -(-length // _SPAN)
        step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
        first, length = np.repeat(first, extra) + step * _SPAN, np.minimum(np.repeat(length, extra) - step * _SPAN, _SPAN)
    return at[first], length, anchor[first]


def _survey(part: Slice) -> list:
    raw = part.data.tobytes()
    first, _, anchor = _segments(part)
    bounds = np.searchsorted(first, part.word_rows)
    anchors, digests = [], []
    for k, (a, b) in enumerate(zip(part.rows[:-1].tolist(), part.rows[1:].tolist())):
        digests.append(hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest())
        anchors.append(np.unique(anchor[bounds[k] : bounds[k + 1]]).view(np.int64))
    return [np.diff(part.word_rows), digests, anchors]


_SEGMENT = T.StructType([
    T.StructField("_id", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("at", T.IntegerType()),
    T.StructField("n", T.IntegerType()), T.StructField("seg", T.BinaryType()), T.StructField("windows", T.BinaryType()),
])


def _digest_segments(batches):
    """Segments of the wanted anchors: columns _id, _row, text, wanted come in."""
    schema = to_arrow_schema(_SEGMENT)
    for batch in batches:
        for part in slices(batch.column(2)):
            first, length, anchor = _segments(part)
            bounds = np.searchsorted(first, part.word_rows)
            ids, keys = batch.column(0).slice(part.first, part.n).to_pylist(), batch.column(1).slice(part.first, part.n).to_pylist()
            wanted = batch.column(3).slice(part.first, part.n)
            raw, rows = part.data.tobytes(), []
            for k in range(part.n):
                lo, hi = bounds[k], bounds[k + 1]
                use = np.flatnonzero(np.isin(anchor[lo:hi].view(np.int64), wanted[k].values.to_numpy())) + lo
                if not len(use):
                    continue
                words = raw[part.rows[k] : part.rows[k + 1]].split()
                text = b" ".join(words)
                size = np.fromiter(map(len, words), np.int64, len(words))
                ends = np.cumsum(size + 1) - 1
                starts = (ends - size).tolist()
                ends = ends.tolist()
                for s in use.tolist():
                    at, n = int(first[s] - part.word_rows[k]), int(length[s])
                    seg = hashlib.blake2b(text[starts[at] : ends[at + n + WINDOW - 2]], digest_size=16).digest()
                    each = b"".join(hashlib.blake2b(text[starts[i] : ends[i + WINDOW - 1]], digest_size=16).digest() for i in range(at, at + n))
                    rows.append((ids[k], keys[k], at, n, seg, each))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _spread_windows(batches):
    """Segment rows (seg, _first, windows) to a row for each window."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("seg", pa.binary()), ("pos", pa.int32()), ("_first", pa.int64())])
    for batch in batches:
        blobs = batch.column(2).to_pylist()
        counts = np.array([len(b) // 16 for b in blobs], np.int64)
        if not counts.sum():
            continue
        halves = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
        of = np.repeat(np.arange(len(blobs)), counts)
        pos = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), batch.column(0).take(pa.array(of)), pa.array(pos.astype(np.int32)), batch.column(1).take(pa.array(of))],
            schema=schema,
        )


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts of the ids in `keys`, where those are few enough to filter by before texts are shuffled; else all texts."""
    ids = keys.select("_id")
    return texts.join(F.broadcast(ids), "_id", "left_semi") if ids.count() <= BROADCAST_ROWS else texts


@contextmanager
def _sorted_scans(spark: SparkSession):
    """Lets scans of bucketed tables use the order of their files, one for each bucket."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Runs:
    """Immutable runs of keys, bucketed and sorted, each with the first document that has a key and whether two have had it."""

    def __init__(self, spark: SparkSession, folder: str, name: str, keys: dict[str, str], buckets: int, fan_in: int):
        self.spark, self.folder, self.name, self.keys, self.buckets, self.fan_in = spark, folder, name, keys, buckets, fan_in
        self.runs: dict[str, str] = {}  # name of the file folder: name of the session's table over it

    def _columns(self) -> str:
        return ", ".join(f"{k} {t}" for k, t in self.keys.items()) + ", first bigint, shared boolean, old bigint"

    def attach(self, name: str) -> DataFrame:
        """Makes a stored run known to the session."""
        self.runs[name] = f"weftlink_{uuid.uuid4().hex}"
        keys = ", ".join(self.keys)
        self.spark.sql(f"CREATE TABLE {self.runs[name]} ({self._columns()}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(self.runs[name])

    def append(self, rows: DataFrame) -> DataFrame:
        """Adds a run of (keys, first, shared, old), which lie by key already, and returns it as stored."""
        name = f"{self.name}-{uuid.uuid4().hex}"
        self.runs[name] = f"weftlink_{uuid.uuid4().hex}"
        writer = rows.select(*self.keys, "first", "shared", "old").write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        writer.option("path", f"{self.folder}/{name}").saveAsTable(self.runs[name])
        return self.spark.table(self.runs[name])

    def look_up(self, rows: DataFrame) -> DataFrame:
        """`rows` with what the runs know of their key: `past`, the first document, and `known`, whether two have had it."""
        past, known = F.lit(None).cast("long"), F.lit(False)
        for k, table_name in enumerate(self.runs.values()):
            run = self.spark.table(table_name).select(*self.keys, F.col("first").alias(f"_first{k}"), F.col("shared").alias(f"_shared{k}"))
            rows = rows.join(run.hint("merge"), list(self.keys), "left")
            past, known = F.least(past, F.col(f"_first{k}")), known | F.coalesce(F.col(f"_shared{k}"), F.lit(False))
        names = [f"_{n}{k}" for k in range(len(self.runs)) for n in ("first", "shared")]
        return rows.withColumns({"past": past, "known": known}).drop(*names)

    def compact(self) -> None:
        """Merges the runs into one, two at a time and bucket by bucket, once there are `fan_in`."""
        if len(self.runs) < max(2, self.fan_in):
            return
        while len(self.runs) > 1:
            old = list(self.runs)[:2]
            a, b = (self.spark.table(self.runs[n]).select(*self.keys, F.col("first").alias(f"f{k}"), F.col("shared").alias(f"s{k}")) for k, n in enumerate(old))
            both = a.join(b.hint("merge"), list(self.keys), "full_outer")
            either = F.coalesce("s0", F.lit(False)) | F.coalesce("s1", F.lit(False)) | (F.col("f0").isNotNull() & F.col("f1").isNotNull())
            self.append(both.select(*self.keys, F.least("f0", "f1").alias("first"), either.alias("shared"), F.lit(None).cast("long").alias("old")))
            merged = list(self.runs)[-1]
            for name in old:
                self.detach(name, True)
            self.runs = {merged: self.runs.pop(merged)} | self.runs

    def detach(self, name: str, files: bool) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.runs.pop(name)}")
        if files:
            drop_path(self.spark, f"{self.folder}/{name}")


_KEYS = {"anchors": {"h": "bigint"}, "windows": {"w1": "bigint", "w2": "bigint"}}


class FingerprintIndex:
    """State that survives from batch to batch. Ids of a batch must exceed those of all before it.

    `documents` holds the texts of the batches to come and of those that went before. `buckets` is how many parts
    a run has, for the life of the index; it should follow the size that the index is to grow to.
    """

    def __init__(self, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2, folder: str | None = None, buckets: int | None = None):
        self.spark = documents.sparkSession
        self.source = small_batches(documents).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
        self.folder = folder or scratch(self.spark, "index")
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.anchors, self.windows = (Runs(self.spark, self.folder, n, _KEYS[n], self.buckets, fan_in) for n in ("anchors", "windows"))
        self.temporary: dict[str, str] = {}
        self.batches = 0
        self.highest: int | None = None
        self.compactions = 0

    @staticmethod
    def open(documents: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2) -> FingerprintIndex:
        """The index that `save` left in a folder."""
        kept = Storage(documents.sparkSession).read_json(f"{folder}/index.json")
        if (kept["window"], kept["gram"]) != (WINDOW, GRAM):
            raise ValueError(f"{folder} holds windows of {kept['window']} words over grams of {kept['gram']}")
        index = FingerprintIndex(documents, id_col=id_col, text_col=text_col, fan_in=fan_in, folder=folder, buckets=kept["buckets"])
        index.highest = kept["highest"]
        for runs in (index.anchors, index.windows):
            for name in kept[runs.name]:
                runs.attach(name)
        return index

    def save(self) -> str:
        """Writes down what the index consists of; the runs are stored already."""
        kept = {"window": WINDOW, "gram": GRAM, "buckets": self.buckets, "highest": self.highest} | {runs.name: list(runs.runs) for runs in (self.anchors, self.windows)}
        Storage(self.spark).write_json(f"{self.folder}/index.json", kept)
        return self.folder

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        self.temporary[name] = scratch(self.spark, name)
        df.write.parquet(self.temporary[name])
        return self.spark.read.parquet(self.temporary[name])

    def _drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, self.temporary.pop(name))

    def add(self, low: int | None, high: int | None) -> tuple[DataFrame, DataFrame]:
        """Takes in the documents with low < id <= high.

        Returns their survey (_id, _row, n_words, sha) and the covered windows (_id, _row, spans).
        """
        if self.highest is not None and (low is None or low < self.highest):
            raise ValueError(f"the index holds ids up to {self.highest}")
        with _sorted_scans(self.spark):
            return self._add(low, high)

    def _add(self, low: int | None, high: int | None) -> tuple[DataFrame, DataFrame]:
        self.batches += 1
        for runs in (self.anchors, self.windows):
            before = len(runs.runs)
            runs.compact()
            self.compactions += len(runs.runs) < before
        docs = self.source.where(F.col("_id").isNotNull())
        if low is not None:
            docs = docs.where(F.col("_id") > low)
        if high is not None:
            docs = docs.where(F.col("_id") <= high)
        fields = [T.StructField("n_words", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("anchors", T.ArrayType(T.LongType()))]
        survey = self._kept(append(docs.withColumn("_row", F.xxhash64("text")), "text", fields, _survey).drop("text"), f"survey-{self.batches}")
        self.highest = high if high is not None else survey.agg(F.max("_id")).first()[0] or self.highest

        occurs = survey.select("_id", F.explode("anchors").alias("h"))
        mine = self.anchors.look_up(occurs.groupBy("h").agg(F.min("_id").alias("own"), F.max("_id").alias("last")))
        met = F.col("past").isNotNull()
        run = self.anchors.append(mine.select("h", F.coalesce("past", "own").alias("first"), (met | (F.col("own") < F.col("last"))).alias("shared"), F.when(met & ~F.col("known"), F.col("past")).alias("old")))

        shared = run.where("shared")
        wanted = occurs.join(shared.select("h"), "h").unionByName(shared.where("old is not null").select(F.col("old").alias("_id"), "h"))
        wanted = self._kept(wanted.groupBy("_id").agg(F.collect_set("h").alias("wanted")), "wanted")
        everyone = self.source if high is None else self.source.where(F.col("_id") <= high)
        segments = self._kept(
            _only(everyone, wanted).join(wanted, "_id").select("_id", F.xxhash64("text").alias("_row"), "text", "wanted").mapInArrow(_digest_segments, _SEGMENT), "segments"
        )

        distinct = self._kept(segments.groupBy("seg").agg(F.min("_id").alias("_first"), F.any_value("windows").alias("windows")), "distinct")
        places = self._kept(segments.drop("windows"), "places")
        self._drop("segments")
        spread = distinct.select("seg", "_first", "windows").mapInArrow(_spread_windows, "w1 long, w2 long, seg binary, pos int, _first long")
        mine = self.windows.look_up(spread.groupBy("w1", "w2").agg(F.min("_first").alias("own")))
        run = self.windows.append(mine.select("w1", "w2", F.least("own", "past").alias("first"), F.lit(True).alias("shared"), F.lit(None).cast("long").alias("old")))
        late = spread.join(run.select("w1", "w2", "first"), ["w1", "w2"]).where(F.col("first") < F.col("_first"))
        mask = late.groupBy("seg").agg(F.bit_or(F.expr("shiftleft(1L, pos)")).alias("mask"))
        # written, so that the join below stands on plain shuffles, which adaptive execution splits at a hot segment
        judged = self._kept(distinct.select("seg", "_first").join(mask, "seg", "left"), "judged")

        here = places if low is None else places.where(F.col("_id") > low)
        full = F.expr("shiftleft(1L, n) - 1")
        covered = here.join(judged, "seg").select("_id", "_row", "at", F.when(F.col("_id") > F.col("_first"), full).otherwise(F.coalesce("mask", F.lit(0))).alias("mask"))
        covered = covered.where("mask <> 0").groupBy("_id", "_row").agg(F.collect_set(F.struct("at", "mask")).alias("spans"))
        covered = self._kept(covered, f"covered-{self.batches}")
        self._drop("wanted", "places", "distinct", "judged")
        return survey.drop("anchors"), covered

    def close(self, keep: bool = False) -> None:
        """Drops scratch tables, and the index itself unless it is kept."""
        for runs in (self.anchors, self.windows):
            for name in list(runs.runs):
                runs.detach(name, not keep)
        self._drop(*list(self.temporary))
        if not keep:
            drop_path(self.spark, self.folder)


def batch_bounds(documents: DataFrame, id_col: str, batches: int) -> list[tuple[int | None, int | None]]:
    """Id ranges (low, high] that cut the rows into about equal batches."""
    cuts = documents.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    return list(zip([None, *cuts], [*cuts, None]))


def _removed_words(n_words: int, spans) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    for span in spans:
        at, mask = span["at"], span["mask"]
        while mask:
            k = (mask & -mask).bit_length() - 1
            edge[at + k] += 1
            edge[at + k + WINDOW] -= 1
            mask &= mask - 1
    return np.cumsum(edge[:-1]) > 0


_CUT = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha", T.StringType()), T.StructField("kept_text", T.StringType())])


def _cut_texts(batches):
    """Columns _id, _row, text, spans come in. The kept text keeps each word's following white space."""
    schema = to_arrow_schema(_CUT)
    for batch in batches:
        for part in slices(batch.column(2)):
            raw = part.data.tobytes()
            ids, keys, spans = (batch.column(c).slice(part.first, part.n) for c in (0, 1, 3))
            removed, digests, texts = [], [], []
            for k in range(part.n):
                lo, hi, end = part.word_rows[k], part.word_rows[k + 1], int(part.rows[k + 1])
                gone = _removed_words(int(hi - lo), spans[k].as_py())
                starts, ends = part.starts[lo:hi].tolist(), part.ends[lo:hi].tolist()
                follow = [*starts[1:], end]
                kept = np.flatnonzero(~gone).tolist()
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(raw[starts[i] : ends[i]] for i in kept)).hexdigest())
                texts.append(b"".join(raw[starts[i] : follow[i]] for i in kept).strip(b" \t\n\r\v\f").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], schema=schema)


def substring_dedup(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, fan_in: int = 2) -> tuple[DataFrame, DataFrame]:
    """(survey, edits), over all documents.

    survey: _id, _row (hash of the text), n_words, sha of each row; edits: _id, _row, n_removed, kept_sha,
    kept_text of each row that loses words. Both are checkpoints; the index itself is deleted.
    """
    index = FingerprintIndex(documents, id_col=id_col, text_col=text_col, fan_in=fan_in)
    found = [index.add(low, high) for low, high in batch_bounds(documents, id_col, batches)]
    result = _results(index, found)
    index.close()
    return result


def extend(index: FingerprintIndex, low: int | None, high: int | None) -> tuple[DataFrame, DataFrame]:
    """(survey, edits) of the documents with low < id <= high, judged against all that the index holds, which then holds them too."""
    return _results(index, [index.add(low, high)])


def _results(index: FingerprintIndex, found: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    survey, covered = found[0]
    for more, spans in found[1:]:
        survey, covered = survey.unionByName(more), covered.unionByName(spans)
    texts = index.source.where("_id is not null").withColumn("_row", F.xxhash64("text"))
    cuts = cut(_only(texts, covered).join(covered, ["_id", "_row"]).dropDuplicates(["_id", "_row"]).select("_id", "_row", "text", "spans").mapInArrow(_cut_texts, _CUT))
    return cut(survey), cuts


def _unnamed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Survey of the rows without an id."""
    rows = documents.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).withColumn("_row", F.xxhash64("text"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("sha", T.StringType())]
    return append(rows, "text", fields, lambda part: _survey(part)[:2]).drop("text")


def digest(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, fan_in: int = 2) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every row."""
    survey, cuts = substring_dedup(documents, id_col=id_col, text_col=text_col, batches=batches, fan_in=fan_in)
    every = survey.unionByName(_unnamed(documents, id_col, text_col)).join(cuts.drop("kept_text"), ["_id", "_row"], "left")
    return every.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def strip_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = 3) -> DataFrame:
    """Documents without the words that repeat an earlier document, with their own columns.

    A row that loses all its words goes; one that loses none keeps its text byte for byte, a row with a null id too.
    """
    _, cuts = substring_dedup(documents, id_col=id_col, text_col=text_col, batches=batches)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    id_key, row_key, new_text = on = [unused(f"_edit_{n}", documents) for n in ("id", "row", "text")]
    keyed = documents.select(*columns, F.col(f"`{id_col}`").cast("long").alias(id_key), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias(row_key))
    edits = cuts.select(*[F.col(a).alias(b) for a, b in zip(("_id", "_row", "kept_text"), on)])
    keys, on = small(edits.drop(new_text)), [id_key, row_key]
    changed = {text_col: F.col(new_text)}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.length(new_text).cast(documents.schema["n_chars"].dataType)
    edited = keyed.join(keys, on, "left_semi").join(edits, on).where(F.col(new_text) != "").select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns])
    return keyed.join(keys, on, "left_anti").select(*columns).unionByName(edited)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 x AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
 f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
 c AS (SELECT DISTINCT doc_id, i + k AS p FROM x JOIN f USING (h), (SELECT unnest(range(0, 50)) AS k) WHERE first < doc_id),
 t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
 k AS (SELECT t.doc_id, count(c.p) AS n_removed, coalesce(string_agg(t.word, ' ' ORDER BY t.p) FILTER (c.p IS NULL), '') AS kept FROM t LEFT JOIN c USING (doc_id, p) GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
