"""Top-k similarity joins and the candidate union.

Queries and targets are packed into stored blocks and meet block by block (`blocks.meet`): a task holds one block of each and keeps k per
query. A window over those survivors gives the global ranks. Ties go to the smaller target id, on scores rounded to `DIGITS`, so
that the order of sums cannot change a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, spread
from .blocks import from_bytes, meet, pack, to_bytes
from .bounds import DIGITS, Asked, Vectors, pair_sums, recent

DENSE_BLOCK = (4096, 1 << 15)  # rows of queries and of targets that meet in a task
SPARSE_BLOCK = (8192, 4096)
TILE = 1 << 21  # scores that a task holds at once
_LONG = T.LongType()


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row; columns come in order of target id. Ties with the k-th stay in."""
    n = scores.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(scores)), n), np.tile(np.arange(n), len(scores))
    bound = np.partition(scores, n - k, axis=1)[:, n - k]
    row, column = np.nonzero(scores >= bound[:, None])
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    return row[place < k], column[place < k]


def ranked(found: DataFrame, k: int, score: str, rank: str) -> DataFrame:
    order = Window.partitionBy("qid", "source").orderBy(F.desc(score), "tid")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def found_schema(queries: DataFrame | T.StructField, targets: DataFrame | T.StructField, score: str) -> T.StructType:
    kind = lambda side, key: (side.schema[key] if isinstance(side, DataFrame) else side).dataType
    return T.StructType([T.StructField("qid", kind(queries, "qid")), T.StructField("tid", kind(targets, "tid")), T.StructField("source", T.IntegerType()), T.StructField(score, T.DoubleType())])


def by_id(table: pa.Table, name: str) -> pa.Table:
    return table.take(pa.array(np.argsort(np.array(table[name].to_pylist(), object), kind="stable")))


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of equally long vectors."""
    column = table[name].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def gathered(q: pa.Table, t: pa.Table, score: str, parts: list[tuple]) -> dict:
    """Columns from (query rows, target rows, scores)."""
    rows, places, scores = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, int) for k in range(3))
    take = lambda table, name, at: table[name].combine_chunks().take(pa.array(at, pa.int64()))
    return {"qid": take(q, "qid", rows), "tid": take(t, "tid", places), "source": take(t, "source", places), score: pa.array(scores, pa.float64())}


def per_source(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Queries once for each source that has targets; sources are few."""
    sources = [r[0] for r in targets.select(F.col("source").cast("int")).distinct().collect()]
    return queries.withColumn("source", F.explode(F.array(*[F.lit(s) for s in sorted(sources)]).cast("array<int>")))


def dense_topk(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(qid, tid, source, dense_score, dense_rank): the k largest inner products of each query and target source.

    queries (qid, embedding), targets (tid, source, embedding). Exact; negative scores count. A null vector
    takes no part.
    """
    use = targets.select("tid", F.col("source").cast("int").alias("source"), "embedding").where("embedding is not null")
    asked = queries.select("qid", F.lit(0).alias("source"), "embedding").where("embedding is not null")

    known = {}

    def ask(data: bytes) -> tuple:
        rows = from_bytes(data)
        return rows, Vectors(matrix(rows, "embedding"), k)

    def search(q: tuple, t: tuple, source: int) -> dict:
        rows, own = recent(known, (q[0], source), lambda: ask(q[1]))
        held = from_bytes(t[1])
        return gathered(rows, held, "dense_score", [own.meet(matrix(held, "embedding"))])

    found = meet(pack(asked, "qid", DENSE_BLOCK[0]), pack(use, "tid", DENSE_BLOCK[1]), search, found_schema(queries, targets, "dense_score"), k, "dense_score")
    return ranked(found, k, "dense_score", "dense_rank")


# ---- character trigrams ------------------------------------------------------------------------------------


def text_grams(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Of each lower-cased text its distinct trigrams in rising order, and how often each occurs."""
    grams, counts = [], []
    for text in texts.to_pylist():
        c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found, n = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True) if len(c) > 2 else (c[:0], c[:0])
        grams.append(found)
        counts.append(n.astype(np.int32))
    return pa.array(grams, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))


def gram_vectors(texts: DataFrame, id_col: str, text_col: str = "lexical") -> DataFrame:
    """`texts` without the text: its distinct lower-cased character trigrams in rising order, and how often each occurs.

    A trigram is three code points of 21 bits in a long, so its order is that of the characters.
    """
    base = texts.select(*[c for c in texts.columns if c != text_col], F.lower(text_col).alias("_text"))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField("grams", T.ArrayType(_LONG)), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            grams, counts = text_grams(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], grams, counts], schema=arrow)

    return spread(base).mapInArrow(run, schema)


def gram_text(gram):
    """The three characters of a trigram column."""
    points = [F.lpad(F.hex(F.shiftright(gram, n).bitwiseAND(F.lit((1 << 21) - 1))), 8, "0") for n in (42, 21, 0)]
    return F.decode(F.unhex(F.concat(*points)), "UTF-32")


def tfidf_vocabulary(vectors: DataFrame, max_features: int = 500_000) -> DataFrame:
    """(source, gram, idf) fitted on the gram vectors of each target source: ln((1 + n) / (1 + df)) + 1.

    The `max_features` grams with the largest total count stay; of equal ones the smaller gram. Texts without a gram
    count among the n; where no text of a source has one, its vocabulary is empty and all its weights are.
    """
    sizes = vectors.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    posts = vectors.select("source", F.explode(F.arrays_zip("grams", "tfs")).alias("p")).groupBy("source", F.col("p.grams").alias("gram"))
    grams = posts.agg(F.count(F.lit(1)).alias("df"), F.sum("p.tfs").alias("total"))
    return _vocabulary(grams, sizes, max_features)


def _vocabulary(grams: DataFrame, sizes: DataFrame, max_features: int) -> DataFrame:
    best = grams.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("total"), "gram"))).where(F.col("_r") <= max_features)
    # one row for each source
    return best.join(F.broadcast(sizes), "source").select("source", "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


@dataclass
class Side:
    """Packed sparse vectors: a block keeps its distinct grams once, and for each row their places and perhaps counts. With `known`, a
    broadcast of (grams, idf) by source, weights follow the source a vector meets; else each gram of a block has its weight there."""

    blocks: DataFrame
    key: T.StructField
    known: object = None

    def entries(self):
        """Function of a block's rows and a source, for tasks: row, place and weight of each entry, and the grams by place.

        A weight from counts is tf * idf, each row of unit length; grams outside the vocabulary are dropped first.
        """
        known = self.known

        def weighed(rows: pa.Table, source: int) -> tuple:
            row, place = _flat(rows["places"])
            names, unit = (np.frombuffer(rows.schema.metadata.get(n, b""), kind) for n, kind in ((b"names", np.int64), (b"unit", float)))
            if known is not None:
                of, idf = known.value.get(source, (np.zeros(0, np.int64), np.zeros(0)))
                at = np.searchsorted(of, names)
                real = at < len(of)
                real[real] = of[at[real]] == names[real]
                unit = np.zeros(len(names))
                unit[real] = idf[at[real]]
            if not unit.all():
                use = unit[place] > 0
                row, place = row[use], place[use]
            else:
                use = slice(None)
            weight = unit[place]
            if known is not None:
                weight *= _flat(rows["tfs"])[1][use]
                weight /= np.sqrt(np.bincount(row, weight * weight, rows.num_rows))[row]
            return row, place, weight, names

        return weighed


def block_of(rows: pa.Table, lists: pa.Array, names: np.ndarray, places: np.ndarray, unit: np.ndarray | None = None, **more: pa.Array) -> pa.Table:
    """A block of sparse rows: the id and source of `rows`, and the places of the lists' entries among `names`."""
    small = np.uint16 if len(names) < 1 << 16 else np.int32
    found = {c: rows[c] for c in rows.column_names[:2]} | {"places": pa.ListArray.from_arrays(lists.offsets, pa.array(places.astype(small)))} | more
    return pa.table(found).replace_schema_metadata({"names": names.astype(np.int64).tobytes()} | ({} if unit is None else {"unit": unit.tobytes()}))


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each entry of a column of lists."""
    column = lists.combine_chunks()
    return np.repeat(np.arange(len(column), dtype=np.int32), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy(zero_copy_only=False)


def pack_texts(texts: DataFrame, id_col: str, text_col: str = "lexical") -> DataFrame:
    """Blocks of the trigram counts of `texts` (id, source, text); every gram of a block with its documents and its count stands beside it."""

    def make(rows: pa.Table) -> pa.Table:
        grams, tfs = text_grams(rows["_text"].combine_chunks())
        names, places = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        return block_of(rows, grams, names, places, tfs=tfs)

    def counts(rows: pa.Table) -> list[dict]:
        names, place = np.frombuffer(rows.schema.metadata[b"names"], np.int64), _flat(rows["places"])[1]
        df = np.bincount(place, minlength=len(names))
        total = np.bincount(place, _flat(rows["tfs"])[1], len(names)).astype(np.int64)
        return [{"gram": g, "df": d, "total": n} for g, d, n in zip(names.tolist(), df.tolist(), total.tolist())]

    kind = T.ArrayType(T.StructType([T.StructField(n, _LONG) for n in ("gram", "df", "total")]))
    rows = texts.select(id_col, F.col("source").cast("int").alias("source"), F.lower(text_col).alias("_text"))
    return pack(rows, id_col, SPARSE_BLOCK[id_col == "tid"], make, {"counts": (kind, counts)})


def packed_vocabulary(blocks: DataFrame, max_features: int = 500_000) -> DataFrame:
    """`tfidf_vocabulary` from the counts of blocks: a row for each gram of a block is shuffled, not one for each of a text."""
    sizes = blocks.groupBy("source").agg(F.sum("n").alias("n"))
    grams = blocks.select("source", F.explode("counts").alias("p")).groupBy("source", F.col("p.gram").alias("gram")).agg(F.sum("p.df").alias("df"), F.sum("p.total").alias("total"))
    return _vocabulary(grams, sizes, max_features)


def sparse_topk(queries: Side, targets: Side, k: int, score: str = "tfidf_score", rank: str = "tfidf_rank") -> DataFrame:
    """(qid, tid, source, score, rank): the k largest inner products among pairs that share a gram.

    Both sides hold distinct grams and positive weights. Nearly all texts hold the label words, so a posting join would make
    all pairs; here a bound of every pair comes from narrow matrices (`bounds.Asked`), pairs that may be among the k best of
    what the task has met are summed exactly, and k per query leave the task.
    """
    asked, of_queries, of_targets = {}, queries.entries(), targets.entries()

    def search(q: tuple, t: tuple, source: int) -> dict:
        rows, own = recent(asked, (q[0], source), lambda: _asked(of_queries, from_bytes(q[1]), source, k))
        held = from_bytes(t[1])
        return gathered(rows, held, score, [own.meet(of_targets(held, source), held.num_rows)])

    schema = found_schema(queries.key, targets.key, score)
    return ranked(meet(queries.blocks, targets.blocks, search, schema, k, score), k, score, rank)


def _asked(entries, rows: pa.Table, source: int, k: int) -> tuple:
    return rows.select(rows.column_names[:2]), Asked(entries(rows, source), rows.num_rows, k)


def _entries(table: pa.Table) -> tuple:
    """Row, place and weight of each entry of a table (id, source, grams, weights), and the grams by place."""
    row, gram = _flat(table["grams"])
    names, place = np.unique(gram, return_inverse=True)
    return row, place, _flat(table["weights"])[1], names


def _sparse_search(q: pa.Table, t: pa.Table, k: int, score: str) -> dict:
    return gathered(q, t, score, _sparse_products(_entries(q), _entries(t), q.num_rows, t.num_rows, k))


def _sparse_products(queries: tuple, targets: tuple, nq: int, nt: int, k: int) -> list[tuple]:
    """(query rows, target rows, scores) of the k best of each query, from the entries of both sides."""
    return [Asked(queries, nq, k).meet(targets, nt)]


def candidate_union(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Full outer merge by pair: both scores and ranks, and the channels that found it."""
    both = dense.join(sparse, ["qid", "tid", "source"], "full_outer")
    channels = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), F.lit("dense")), F.when(F.col("tfidf_rank").isNotNull(), F.lit("tfidf"))))
    return both.withColumn("channels", channels)


def fill_dense(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact inner product where the dense channel did not find a pair."""
    missing = pairs.where("dense_rank is null").select("qid", "tid")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    filled = missing.join(queries.select("qid", F.col("embedding").alias("a")), "qid").join(targets.select("tid", F.col("embedding").alias("b")), "tid").select("qid", "tid", F.round(dot, DIGITS).alias("_dense"))
    return pairs.join(filled, ["qid", "tid"], "left").withColumn("dense_score", F.coalesce("dense_score", "_dense")).drop("_dense")


def fill_sparse(pairs: DataFrame, queries: Side, targets: Side) -> DataFrame:
    """Exact cosine where the lexical channel did not find a pair; 0 without a common gram.

    The missing pairs travel with the block of their query past the blocks of targets, so no vector is joined to a pair.
    """
    missing = pairs.where("tfidf_rank is null").select("qid", "tid")
    kind = to_arrow_schema(T.StructType([queries.key]))[0].type

    def ids(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = from_bytes(data.as_py())["qid"].combine_chunks()
                yield pa.RecordBatch.from_arrays([found.cast(kind), pa.array([block] * len(found), pa.int64())], names=["qid", "block"])

    owners = queries.blocks.select("block", "data").mapInArrow(ids, T.StructType([queries.key, T.StructField("block", _LONG)])).distinct()
    wanted = missing.join(owners, "qid").groupBy("block").agg(F.collect_list("qid").alias("wq"), F.collect_list("tid").alias("wt"))
    asking = cut(queries.blocks.select("block", "data").join(wanted, "block").mapInArrow(_stored_pairs, "block long, data binary, pairs binary"))
    schema = T.StructType([T.StructField("qid", queries.key.dataType), T.StructField("tid", targets.key.dataType), T.StructField("_sparse", T.DoubleType())])
    known, of_queries, of_targets = {}, queries.entries(), targets.entries()

    def ask(q: tuple) -> tuple:
        rows, pairs = from_bytes(q[1]), from_bytes(q[2])
        return rows, pairs, pc.index_in(pairs["qid"], rows["qid"].combine_chunks()).to_numpy()

    def search(q: tuple, t: tuple, source: int) -> dict | None:
        rows, pairs, of = recent(known, q[0], lambda: ask(q))
        held = from_bytes(t[1])
        at = pc.index_in(pairs["tid"], held["tid"].combine_chunks())
        here = np.flatnonzero(pc.is_valid(at).to_numpy())
        if not len(here):
            return None
        (qu, qi), (tu, ti) = (np.unique(x, return_inverse=True) for x in (of[here], at.drop_null().to_numpy()))
        left, right = of_queries(rows.take(pa.array(qu)), source), of_targets(held.take(pa.array(tu)), source)
        sums = np.round(pair_sums(left, len(qu), right, len(tu), qi, ti), DIGITS)
        return {c: pairs[c].take(pa.array(here)) for c in ("qid", "tid")} | {"_sparse": pa.array(sums, pa.float64())}

    sums = meet(asking, targets.blocks, search, schema, None, "_sparse", ["data", "pairs"])
    return pairs.join(sums, ["qid", "tid"], "left").withColumn("tfidf_score", F.coalesce("tfidf_score", "_sparse", F.lit(0.0))).drop("_sparse")


def _stored_pairs(batches):
    """Blocks whose wanted pairs, lists of qid and tid, are packed."""
    for batch in batches:
        for row in range(batch.num_rows):
            pairs = pa.table({c: batch.column(n)[row].values for c, n in (("qid", "wq"), ("tid", "wt"))})
            yield pa.RecordBatch.from_arrays([batch.column("block").slice(row, 1), batch.column("data").slice(row, 1).cast(pa.binary()), pa.array([to_bytes(pairs)], pa.binary())], names=["block", "data", "pairs"])


def known_idf(vocabulary: DataFrame):
    """Broadcast (grams, idf) by source. At most max_features rows a source, a bound that no corpus moves."""
    known = {}
    for source, rows in vocabulary.select("source", "gram", "idf").toPandas().groupby("source"):
        rows = rows.sort_values("gram")
        known[int(source)] = (rows["gram"].to_numpy(), rows["idf"].to_numpy())
    return vocabulary.sparkSession.sparkContext.broadcast(known)


def lexical_weights(queries: DataFrame, targets: DataFrame, max_features: int = 500_000) -> tuple[Side, Side]:
    """Packed vectors of queries (qid, lexical), which meet any source, and of targets (tid, source, lexical)."""
    held = pack_texts(targets.select("tid", "source", "lexical"), "tid")
    asked = pack_texts(queries.select("qid", F.lit(0).alias("source"), "lexical"), "qid")
    known = known_idf(packed_vocabulary(held, max_features))
    return Side(asked, queries.schema["qid"], known), Side(held, targets.schema["tid"], known)


def retrieve(queries: DataFrame, targets: DataFrame, *, top_k_dense: int = 150, top_k_tfidf: int = 150, max_features: int = 500_000, dense=dense_topk, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Candidate pairs of both channels with both similarities.

    queries (qid, lexical, embedding), targets (tid, source, lexical, embedding); `dense` is the dense channel. The embeddings may be in
    `vectors` instead, (qid, embedding) and (tid, source, embedding).
    """
    asked, held = vectors or (queries.select("qid", "embedding"), targets.select("tid", "source", "embedding"))
    query_weights, target_weights = lexical_weights(queries, targets, max_features)
    found = dense(asked, held, top_k_dense)
    pairs = cut(candidate_union(found, sparse_topk(query_weights, target_weights, top_k_tfidf)))
    return fill_sparse(fill_dense(pairs, asked, held), query_weights, target_weights)
