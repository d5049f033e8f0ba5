"""Groups of texts by the Jaccard similarity of their word shingles, exactly.

Equal shingle sets are one set first. Two sets of at least `percent` similarity share a shingle among the
first n - ceil(percent n / 100) + 1 of either in any common order (prefix filter), so sets meet there and nothing is
missed. The order puts shingles of many texts last, by a sketch of counts: it decides the cost, never the result.

Pairs are proposed in three steps, each of which leaves out what the ones before have joined: by the Gray index over the
sets' SimHash fingerprints and by the least set of each shared shingle; by a set of each shingle that a hash picks;
and last every pair that shares a shingle and is still in two groups. No pair is verified twice. A *parity sketch*,
one bit a shingle that flips with each member it stands for, differs in at most as many bits as two sets have members apart; pairs
that are too far by it are dropped before anything is made of them, the others are verified on the whole sets.

Defined results: null and blank texts have the empty set and are equal; a text shorter than a shingle is one
shingle; letters A-Z count as small ones; rows with a null id are in no group.
"""

from __future__ import annotations

import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..session import cut, drop_path, scratch
from .frames import append, project, small, sweep
from .textkernel import Slice, mix, slices

_BASE = 0xC2B2AE3D27D4EB4F
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SMALL_LETTERS = np.arange(256, dtype=np.uint8)
_SMALL_LETTERS[65:91] += 32
_CELLS = 1 << 20
_CHUNK = 1 << 16


def shingle_sets(part: Slice, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, in rising order."""
    n = len(part.starts)
    powers = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps, dtype=np.uint64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(replace(part, data=_SMALL_LETTERS[part.data]).word_hashes() * powers[0][:n], dtype=np.uint64, out=total[1:])
    every = mix((total[words:] - total[:-words]) * powers[1][: n - words + 1]) if n >= words else total[:0]
    found = []
    for a, b in zip(part.word_rows[:-1].tolist(), part.word_rows[1:].tolist()):
        if b - a >= words:
            found.append(np.unique(every[a : b - words + 1]))
        else:
            found.append(mix((total[b : b + 1] - total[a : a + 1]) * powers[1][a : a + 1] + np.uint64(b - a)) if b > a else total[:0])
    return found


def _digest(values: np.ndarray) -> int:
    """Of a set; sums of mixed members, which no order changes."""
    sums = np.array([values.sum(dtype=np.uint64), mix(values ^ np.uint64(_BASE)).sum(dtype=np.uint64), len(values)], np.uint64)
    steps = np.array([_BASE, 1, 1], np.uint64)
    return int(mix((sums * steps).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def set_simhash(values: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, as a signed long: a bit is set where over half the members have it."""
    ones = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values)).view(">i8")[0])


def parity_sketch(values: np.ndarray) -> np.ndarray:
    """At least one bit for each member, a power of two of longs; a bit is set where an odd number of members fall."""
    longs = 1 << max(0, (-(-len(values) // 64) - 1).bit_length())
    odd = np.bincount((values & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketch_gap(x: Column, y: Column) -> Column:
    """Bits in which two parity sketches differ, the longer one folded to the other's length; never more than the members apart."""
    half = lambda s: F.floor(F.size(s) / 2).cast("int")
    fold = lambda s: F.zip_with(F.slice(s, 1, half(s)), F.slice(s, half(s) + 1, half(s)), lambda p, q: p.bitwiseXOR(q))
    a, b = F.when(F.size(x) > F.size(y), fold(x)).otherwise(x), F.when(F.size(y) > F.size(x), fold(y)).otherwise(y)
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def _cells(batches, words: int):
    counts = np.zeros(_CELLS, np.int64)
    for batch in batches:
        for part in slices(batch.column(0)):
            counts += np.bincount((np.concatenate(shingle_sets(part, words)) & np.uint64(_CELLS - 1)).astype(np.int64), minlength=_CELLS)
    if counts.any():
        blobs = [zlib.compress(counts[k : k + _CHUNK].tobytes(), 1) for k in range(0, _CELLS, _CHUNK)]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(blobs)), pa.int32()), "counts": blobs})


def _sum_cells(key, frame):
    import pandas as pd

    total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in frame["counts"])
    return pd.DataFrame({"chunk": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def _frequencies(texts: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of each of _CELLS cells occur; a fixed 8 MB."""
    parts = texts.mapInArrow(lambda batches: _cells(batches, words), "chunk int, counts binary").groupBy("chunk").applyInPandas(_sum_cells, "chunk int, counts binary")
    counts = np.zeros(_CELLS, np.int64)
    for row in parts.collect():
        counts[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    return counts


def _enough(shared, a, b, percent: int):
    """Whether sets of a and b members that share so many are similar enough."""
    return shared.cast("long") * (100 + percent) >= (a + b).cast("long") * percent


def _near(x: Column, y: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of a and b members with these sketches may be similar enough."""
    lengths = (100 * F.least(a, b).cast("long") >= percent * F.greatest(a, b).cast("long"))
    return lengths & (_sketch_gap(x, y).cast("long") * (100 + percent) <= (a + b).cast("long") * (100 - percent))


class _Join:
    """State of one run: the texts, the distinct sets, and the links and pairs so far."""

    def __init__(self, texts: DataFrame, sets: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.texts, self.sets, self.id_col, self.text_col, self.words, self.percent = texts, sets, id_col, text_col, words, percent
        self.links: DataFrame | None = None
        self.seen: DataFrame | None = None

    def verify(self, pairs: DataFrame, sketched: bool = False) -> None:
        """Adds those of the pairs (a, b), a < b, that are new and similar enough to the links."""
        new = pairs.distinct()
        if self.seen is not None:
            new = new.join(self.seen, ["a", "b"], "left_anti")
        if not sketched:
            side = lambda key, n, x: self.sets.select(F.col("_set").alias(key), F.col("_n").alias(n), F.col("_sketch").alias(x))
            new = new.join(side("a", "an", "x"), "a").join(side("b", "bn", "y"), "b").where(_near(F.col("x"), F.col("y"), F.col("an"), F.col("bn"), self.percent)).select("a", "b")
        new = cut(new)
        self.seen = new if self.seen is None else self.seen.unionByName(new)
        if new.isEmpty():
            self.links = new if self.links is None else self.links
            return
        met = cut(self.sets.join(new.select(F.explode(F.array("a", "b")).alias("_set")).distinct(), "_set").select("_set", F.col("_first").alias("_of")))
        fields, words = [T.StructField("_set", T.LongType()), T.StructField("_members", T.ArrayType(T.LongType()))], self.words

        def members(part: Slice) -> list:
            found = shingle_sets(part, words)
            return [[_digest(s) for s in found], [s.view(np.int64) for s in found]]

        whole = append(self.texts.join(small(met.select("_of")), F.col(self.id_col) == F.col("_of"), "left_semi"), self.text_col, fields, members).select("_set", "_members")
        # members travel once by set and once by pair; a text that stands under several ids gives the same members again
        ends = new.select(F.explode(F.array("a", "b")).alias("_set"), "a", "b")
        both = whole.dropDuplicates(["_set"]).join(ends, "_set").groupBy("a", "b").agg(F.min("_members").alias("x"), F.max("_members").alias("y"), F.count(F.lit(1)).alias("n"))
        good = cut(both.where((F.col("n") == 2) & _enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), self.percent)).select("a", "b"))
        self.links = good if self.links is None else self.links.unionByName(good)
        sweep(self.texts.sparkSession)

    def groups(self) -> DataFrame:
        """(_set, _group) of the sets that have a link."""
        return cut(connected_components(self.links, "a", "b").withColumnsRenamed({"node": "_set", "component": "_group"}))

    def mixed(self, posts: DataFrame) -> DataFrame:
        """Posts of the shingles that sets of two groups share, with the group of each."""
        placed = posts.drop("_group").join(small(self.groups()), "_set", "left").withColumn("_group", F.coalesce("_group", "_set"))
        several = placed.groupBy("h").agg(F.min("_group").alias("low"), F.max("_group").alias("high")).where("low < high").select("h")
        return cut(placed.join(several, "h", "left_semi"))


def similar_groups(documents: DataFrame, proposals=None, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, component_id): the smallest id reachable over links of at least `percent` similarity.

    `proposals` maps a table (_bits, _first) of SimHash fingerprints and sets to pairs (node, root) of sets to verify
    first; they may be wrong, and need not be whole. The result is computed when this returns.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    texts = project(documents, id_col, text_col).where(F.col(id_col).isNotNull())
    order = texts.sparkSession.sparkContext.broadcast(_frequencies(texts.select(text_col), words))
    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("_set", T.LongType()), T.StructField("_n", T.IntegerType()), T.StructField("_bits", T.LongType()), T.StructField("_prefix", longs), T.StructField("_sketch", longs)]

    def outline(part: Slice) -> list:
        found, first = shingle_sets(part, words), []
        for s in found:
            ranked = s[np.lexsort((s, order.value[s & np.uint64(_CELLS - 1)]))]
            first.append(ranked[: len(s) + percent * len(s) // -100 + 1].view(np.int64))
        return [[_digest(s) for s in found], [len(s) for s in found], [set_simhash(s) for s in found], first, [parity_sketch(s) for s in found]]

    spark, paths = texts.sparkSession, {}

    def stored(df: DataFrame, name: str) -> DataFrame:
        paths[name] = scratch(spark, name)
        df.write.parquet(paths[name])
        return spark.read.parquet(paths[name])

    rows = stored(append(texts, text_col, fields, outline).drop(text_col), "outlines")
    sets = stored(rows.groupBy("_set").agg(F.min(id_col).alias("_first"), *[F.any_value(c).alias(c) for c in ("_n", "_bits", "_prefix", "_sketch")]), "sets")
    owners = cut(rows.select(id_col, "_set"))
    drop_path(spark, paths.pop("outlines"))
    sweep(spark)
    join = _Join(texts, sets, id_col, text_col, words, percent)

    # shuffled once by shingle; the heads and the posts that they meet are both read from there
    posts = sets.select("_set", F.posexplode("_prefix").alias("_at", "h")).repartition("h")
    heads = posts.groupBy("h").agg(F.min("_set").alias("head"), F.max("_set").alias("last"), F.min("_at").alias("least"))
    heads = heads.where("head < last and least >= 0").select("h", "head")  # every place is; but without it the heads would be read from a shuffle of their own
    met = cut(posts.join(heads, "h"))
    sweep(spark)
    posts = met.drop("head")
    with_head = lambda met: met.where("_set <> head").select(F.least("_set", "head").alias("a"), F.greatest("_set", "head").alias("b"))
    first = with_head(met)
    if proposals is not None:
        found = proposals(sets.select("_bits", F.col("_set").alias("_first")))
        first = first.unionByName(found.where("node <> root").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")))
    join.verify(first)

    posts, met, first = join.mixed(posts), None, None
    by = F.xxhash64("h", "_set")
    heads = posts.groupBy("h").agg(F.min_by("_set", by).alias("head"), F.min_by("_group", by).alias("of"))
    join.verify(with_head(posts.join(heads, "h").where("_group <> of")))

    # sketches make the widest shuffle: both sides are read from one
    posts = join.mixed(posts).join(sets.select("_set", "_n", "_sketch"), "_set").repartition("h")
    other = posts.withColumnsRenamed({"_set": "b", "_n": "bn", "_at": "bt", "_group": "bg", "_sketch": "y"})
    # sets that first meet at these places share no more than what follows; true pairs pass where they first meet
    could = _enough(F.least(F.col("_n") - F.col("_at"), F.col("bn") - F.col("bt")), F.col("_n"), F.col("bn"), percent)
    apart = (F.col("_set") < F.col("b")) & (F.col("_group") != F.col("bg")) & could
    rest = posts.join(other, "h").where(apart & _near(F.col("_sketch"), F.col("y"), F.col("_n"), F.col("bn"), percent))
    join.verify(rest.select(F.col("_set").alias("a"), "b"), sketched=True)

    named = cut(sets.select("_set", "_first").join(join.groups(), "_set", "left").withColumn("_group", F.coalesce("_group", "_set")))
    least = named.groupBy("_group").agg(F.min("_first").alias("component_id"))
    result = cut(owners.join(named.join(least, "_group").select("_set", "component_id"), "_set").drop("_set"))
    for path in paths.values():
        drop_path(spark, path)
    return result
