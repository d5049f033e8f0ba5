"""SimHash near-duplicates (operator 4) over a Gray-ordered hierarchical index.

A fingerprint has a bit set where over half of the XXH64 values of a text's word shingles have it; two
fingerprints link at `max_bits` or fewer differing bits. Search runs on *distinct* fingerprints, each
represented by its smallest id. They are dealt by pigeonhole: of four 16-bit blocks two differing bits
leave at least two intact, so linked fingerprints share one of six 32-bit keys. A key that holds more than
`hot_rows` fingerprints is dealt again by thirds of its other 32 bits, of which one stays intact; after that a bucket
has at most 2^22 distinct values whatever the input. Each task sorts what it got by Gray rank, builds
the index and returns a spanning forest of its links, never the pairs; forests meet in a distributed
component search.

Defined results: null and blank texts have fingerprint zero and link like any other; texts shorter than a
shingle hash as one shingle; equal rows share a component; an empty table gives no rows; a null id keeps
its fingerprint and takes the component of its links, but names none itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..session import cut, table
from .frames import append, project, small, unused
from .shingle_join import similar_groups
from .textkernel import Slice

SEED = 42
_STEP = 1 << 16


def simhash(part: Slice, words: int = 3) -> np.ndarray:
    """A fingerprint for each row of a slice, as unsigned 64-bit numbers."""
    raw, digest = part.data.tobytes(), xxhash.xxh64_digest
    out = np.zeros(part.n, np.uint64)
    pending: list[bytes] = []
    owners: list[tuple[int, int]] = []  # row, shingles
    counts = np.zeros((part.n, 64), np.int64)
    sizes = np.zeros(part.n, np.int64)

    def flush() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(pending), np.uint8).reshape(-1, 8), axis=1)
        at, marks, rows = 0, [], []
        for row, n in owners:  # a byte lane holds the sum of at most 255 rows
            for k in range(at, at + n, 255):
                marks.append(k)
                rows.append(row)
            at += n
        lanes = np.add.reduceat(bits.view(np.uint64), marks, axis=0).view(np.uint8)
        np.add.at(counts, rows, lanes)
        pending.clear()
        owners.clear()

    for row in range(part.n):
        split = raw[part.rows[row] : part.rows[row + 1]].lower().split()
        if not split:
            continue
        text = b" ".join(split)
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        if len(split) > words:
            starts, ends = starts[: 1 - words], ends[words - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        sizes[row] = len(starts)
        for k in range(0, len(starts), _STEP):
            found = [digest(text[a:b], SEED) for a, b in zip(starts[k : k + _STEP].tolist(), ends[k : k + _STEP].tolist())]
            pending += found
            owners.append((row, len(found)))
            if len(pending) >= _STEP:
                flush()
    if pending:
        flush()
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[:] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, _bits): the fingerprint of every whole text as a signed long."""
    field = T.StructField("_bits", T.LongType())
    return append(project(documents, id_col, text_col), text_col, [field], lambda part: [simhash(part, words).view(np.int64)]).drop(text_col)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over Gray-sorted codes.

    A node keeps the bits that all codes below it share and its parent does not already hold, so the
    differences found on the way down add up to a lower bound, which at a leaf is the distance.
    """

    def __init__(self, codes: np.ndarray, fanout: int = 8):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.fanout = fanout
        values = codes[self.order]
        both, either = values, values  # AND and OR of a node's codes: shared bits are where they agree
        levels = [(values, np.full(len(values), ~np.uint64(0)))]
        while len(both) > fanout:
            marks = np.arange(0, len(both), fanout)
            both, either = np.bitwise_and.reduceat(both, marks), np.bitwise_or.reduceat(either, marks)
            levels.append((both, ~(both ^ either)))
        self.levels = []
        for k, (pattern, mask) in enumerate(levels):
            if k + 1 < len(levels):
                mask = mask & ~np.repeat(levels[k + 1][1], fanout)[: len(mask)]
            self.levels.append((pattern, mask))

    def within(self, queries: np.ndarray, most: int, block: int = 512):
        """Yields (query positions, code positions) of all pairs that differ in `most` bits or fewer."""
        for first in range(0, len(queries), block):
            part = queries[first : first + block]
            top = len(self.levels[-1][0])
            q, node = np.repeat(np.arange(len(part)), top), np.tile(np.arange(top), len(part))
            seen = np.zeros(len(q), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                pattern, mask = self.levels[depth]
                seen = seen + np.bitwise_count((part[q] ^ pattern[node]) & mask[node])
                near = seen <= most
                q, node, seen = q[near], node[near], seen[near]
                if depth:
                    width = len(self.levels[depth - 1][0])
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    q, seen = np.repeat(q, self.fanout), np.repeat(seen, self.fanout)
                    real = node < width
                    q, node, seen = q[real], node[real], seen[real]
            yield first + q, self.order[node]


def _forest(codes: np.ndarray, names: np.ndarray, most: int) -> np.ndarray:
    """For each distinct code the smallest name in its local component."""
    label = np.argsort(np.argsort(names, kind="stable"), kind="stable")  # by rank, to compare as numbers
    for a, b in GrayIndex(codes).within(codes, most):
        a, b = a[a < b], b[a < b]
        while len(a):
            la, lb = label[a], label[b]
            odd = la != lb
            if not odd.any():
                break
            a, b, la, lb = a[odd], b[odd], la[odd], lb[odd]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            root = np.arange(len(codes))
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            label = root[label]
    return np.sort(names, kind="stable")[label]


_BLOCKS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
_THIRDS = [(0, 11), (11, 11), (22, 10)]


def _bits(column, shift: int, width: int):
    return F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1))


def _dealt(groups: DataFrame, hot_rows: int) -> DataFrame:
    """Each fingerprint once for each key it is searched under; (scheme, key) names the bucket."""
    bits = F.col("_bits")
    keys = []
    for i, (a, b) in enumerate(_BLOCKS):
        rest = [k for k in range(4) if k not in (a, b)]
        pack = lambda x, y: F.shiftleft(_bits(bits, 16 * x, 16), 16).bitwiseOR(_bits(bits, 16 * y, 16))
        keys.append(F.struct(F.lit(i).alias("scheme"), pack(a, b).alias("key"), pack(*rest).alias("rest")))
    dealt = groups.select("_bits", "_first", F.explode(F.array(*keys)).alias("k")).select("_bits", "_first", "k.*")
    hot = dealt.groupBy("scheme", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("scheme", "key", F.lit(True).alias("hot"))
    marked = dealt.join(hot, ["scheme", "key"], "left")
    thirds = F.array(*[F.shiftleft(F.lit(t + 1).cast("long"), 16).bitwiseOR(_bits(F.col("rest"), at, width)) for t, (at, width) in enumerate(_THIRDS)])
    return marked.withColumn("sub", F.explode(F.when(F.col("hot"), thirds).otherwise(F.array(F.lit(0).cast("long"))))).select("_bits", "_first", "scheme", "key", "sub")


def near_links(groups: DataFrame, max_bits: int = 2, hot_rows: int = 4096, task_rows: int = 100_000) -> DataFrame:
    """(node, root): links that span the groups of codes of at most `max_bits` bits, from stored (_bits, _first), one row a code.

    `max_bits` may be 0, 1 or 2, for which the dealing above is exact. Tasks follow the rows: about `task_rows`
    dealt codes each, so that the memory of one does not grow with the input.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    used = groups.where(F.col("_first").isNotNull())
    cores = groups.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, used.count()), -(-len(_BLOCKS) * used.count() // task_rows), 1)
    return _dealt(used, hot_rows).repartition(tasks, "scheme", "key", "sub").mapInPandas(lambda batches: _local_links(batches, max_bits), "node long, root long")


def near_duplicate_components(prints: DataFrame, *, id_col: str = "doc_id", max_bits: int = 2, hot_rows: int = 4096, task_rows: int = 100_000) -> DataFrame:
    """`prints` (id, _bits) with component_id, the smallest id reachable over links of `max_bits` bits."""
    groups = cut(prints.groupBy("_bits").agg(F.min(id_col).alias("_first")))
    links = near_links(groups, max_bits, hot_rows, task_rows)
    roots = connected_components(links, "node", "root").withColumnsRenamed({"node": "_first"})
    named = groups.join(roots, "_first", "left").select("_bits", F.coalesce("component", "_first").alias("component_id"))
    return prints.join(named, "_bits", "left")


def _local_links(batches, max_bits: int):
    got = [b[["_bits", "_first"]] for b in batches if len(b)]
    if not got:
        return
    every = pd.concat(got, ignore_index=True).drop_duplicates("_bits")
    codes, names = every["_bits"].to_numpy().view(np.uint64), every["_first"].to_numpy()
    root = _forest(codes, names, max_bits)
    moved = root != names
    yield pd.DataFrame({"node": names[moved], "root": root[moved]})


def one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, percent: int | None = None) -> DataFrame:
    """Documents that have the smallest id of their component, with their own columns; rows with a null id stay.

    With `percent`, documents link at that Jaccard similarity of their shingle sets, whatever their bits: the
    index proposes pairs from the sets' fingerprints, `similar_groups` verifies them on whole texts and finds the pairs
    that bits miss. Of rows that repeat a kept id all stay.
    """
    if percent is None:
        found = near_duplicate_components(cut(fingerprints(documents, id_col=id_col, text_col=text_col, words=words)), id_col=id_col, max_bits=max_bits)
    else:
        found = similar_groups(documents, lambda codes: near_links(cut(codes.groupBy("_bits").agg(F.min("_first").alias("_first"))), max_bits), id_col=id_col, text_col=text_col, words=words, percent=percent)
    mark = unused("_drop", documents)
    drop = cut(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(mark)).distinct())
    return documents.join(small(drop), F.col(id_col) == F.col(mark), "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(fingerprints(table(spark, sf_dir, "documents")))
    return near_duplicate_components(prints).select("doc_id", F.lower(F.lpad(F.hex("_bits"), 16, "0")).alias("fingerprint"), "component_id")


GROUPS_SQL = """
WITH RECURSIVE c AS (SELECT doc_id, CAST(xor((doc_id // 3 * 1000003) % 1099511627776, CAST(1 AS BIGINT) << (doc_id % 3 * 7)) AS BIGINT) AS code FROM documents),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM c a JOIN c b ON bit_count(xor(a.code, b.code)) <= 2),
 w AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a)
SELECT a AS doc_id, min(b) AS component_id FROM w GROUP BY a
"""


def code_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of `op4_simhash` that SQL can state: components of codes within two bits, over codes made from the ids."""
    code = ((F.floor(F.col("doc_id") / 3) * 1000003) % (1 << 40)).bitwiseXOR(F.expr("shiftleft(1L, cast(doc_id % 3 * 7 as int))"))
    return near_duplicate_components(cut(table(spark, sf_dir, "documents").select("doc_id", code.alias("_bits")))).select("doc_id", "component_id")
