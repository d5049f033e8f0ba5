"""Toxicity (operator 2): subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams, end marks included, and of itself, each hashed to a row of an
embedding table. Word vectors are the mean of their rows, a passage (`PASSAGE` consecutive words, short ones
filled up with zeros, repeats counted once) the mean of its words, and a two-class softmax on top is
trained jointly with the table. A document is as toxic as its worst
passage: training weighs a document's passages by a softmax of their own logits, so that the label of a
long document lands where it belongs. Misspelt and inflected forms share n-gram rows with known ones.

After training the table and the softmax fold into one number for each row, which is what scoring reads.

Defined results: null, empty and blank texts get the score of an empty passage, the softmax of its bias; a null id is never held out;
rows are scored one by one, so ties and repeated rows agree; an empty table gives no rows; without
labelled rows of both classes every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table
from .frames import append, labelled_sample, project, release_memory
from .textkernel import INK, Slice, mix, slices

PASSAGE = 8
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
BLOCK = 1 << 19  # n-grams handled at once in training
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capitals of Latin-1 in UTF-8."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] |= 0x20
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


def _padded(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words between single blanks, and where each word begins and ends there."""
    size = part.ends - part.starts
    starts = np.cumsum(size + 1) - size
    out = np.full(int(size.sum()) + len(size) + 1, 0x20, np.uint8)
    ink = INK[part.data]
    at = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(size) + 1), size)
    out[at] = _lower(part.data)[ink]
    return out, starts, starts + size


def _gram_rows(text: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Yields (first positions, table rows, words) of the n-grams of each order, then of the words."""
    word = np.repeat(np.arange(len(starts)), ends - starts + 1)  # of each position from a word's left mark on
    position = np.arange(len(word))
    limit = np.repeat(ends + 1, ends - starts + 1)
    rolling = np.zeros(len(text), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling[: len(text) - n + 1] = rolling[: len(text) - n + 1] * np.uint64(1000003) + text[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            use = position + n <= limit
            yield position[use], _bucket(rolling[: len(word)][use], n), word[use]


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - 18)).astype(np.int32)


def _gram_counts(size: np.ndarray) -> np.ndarray:
    """N-grams of a word of `size` bytes with two end marks, itself included."""
    return 1 + sum(np.maximum(size + 2 - n + 1, 0) for n in GRAMS)


def _passages(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage, and its row; a row without words has one empty passage."""
    counts = np.diff(part.word_rows)
    each = np.maximum(-(-counts // PASSAGE), 1)
    row = np.repeat(np.arange(part.n), each)
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return part.word_rows[row] + step * PASSAGE, row


@dataclass
class ToxicityModel:
    weights: np.ndarray  # for each table row, the difference of the two classes' logits
    bias: float

    def word_logits(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Logit difference and content hash of each word."""
        if not len(part.starts):
            return np.zeros(0), np.zeros(0, np.uint64)
        text, starts, ends = _padded(part)
        total = np.zeros(len(text) + 1)
        for at, rows, _ in _gram_rows(text, starts, ends):
            total[at] += self.weights[rows]
        total = np.concatenate(([0.0], np.cumsum(total)))
        hashes = part_hashes(part, text, starts, ends)
        return (total[ends] - total[starts - 1] + self.weights[_bucket(hashes, 0)]) / _gram_counts(ends - starts), hashes

    def score(self, part: Slice) -> np.ndarray:
        """For each row the probability of label 1 in its worst passage."""
        words, hashes = self.word_logits(part)
        first, row = _passages(part)
        of = _passage_of_words(part, first)
        once = _first_of_each(of, hashes)
        logit = np.bincount(of[once], words[once], len(first)) / PASSAGE + self.bias
        worst = np.full(part.n, -np.inf)
        np.maximum.at(worst, row, logit)
        return 1 / (1 + np.exp(-np.clip(worst, -30, 30)))


def _passage_of_words(part: Slice, first: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, np.arange(len(part.starts)), "right") - 1


def _first_of_each(passage: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of words that do not repeat an earlier one of their passage."""
    key = mix(hashes + passage.astype(np.uint64) * _MIX)
    return np.sort(np.unique(key, return_index=True)[1])


def part_hashes(part: Slice, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content hash of the lower-cased words."""
    return Slice(0, 1, text, np.array([0, len(text)]), starts, ends, np.array([0, len(starts)])).word_hashes()


def _bags(texts: list[str]):
    """N-grams of the distinct words, and how many each has; then each passage's words, their passages, and the passages' documents."""
    tokens, places, owners, flat, sizes = [], [], [], [], []
    words: dict[int, int] = {}
    passages, doc = 0, 0
    for part in slices(pa.array(texts, pa.string()), 1 << 17):
        if len(part.starts):
            text, starts, ends = _padded(part)
            whole = part_hashes(part, text, starts, ends)
            grams = [(w.astype(np.int32), r) for _, r, w in _gram_rows(text, starts, ends)] + [(np.arange(len(starts), dtype=np.int32), _bucket(whole, 0))]
            owner, rows = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
            distinct, where, back = np.unique(whole, return_index=True, return_inverse=True)
            known = np.array([words.get(h, -1) for h in distinct.tolist()], np.int64)
            new = np.flatnonzero(known < 0)
            known[new] = len(words) + np.arange(len(new))
            words.update(zip(distinct[new].tolist(), known[new].tolist()))
            place = np.full(len(starts), -1, np.int64)
            place[where[new]] = np.arange(len(new))
            use = np.flatnonzero(place[owner] >= 0)
            use = use[np.argsort(place[owner[use]], kind="stable")]
            flat.append(rows[use].astype(np.int32))
            sizes.append(np.bincount(place[owner[use]], minlength=len(new)))
            of = _passage_of_words(part, _passages(part)[0])
            once = _first_of_each(of, whole)
            tokens.append(known[back][once].astype(np.int32))
            places.append((of[once] + passages).astype(np.int32))
        row = _passages(part)[1]
        owners.append(row + doc)
        passages += len(row)
        doc += part.n
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(flat), join(sizes), join(tokens), join(places), join(owners)


def train(texts: list[str], toxic: np.ndarray, *, dim: int = 4, steps: int = 60, rate: float = 0.1, decay: float = 0.015, spread: float = 0.05, seed: int = 0) -> ToxicityModel:
    """Full-batch Adam on the class-balanced log loss of documents; `decay` is shared out over the rows of label 1."""
    if not len(texts) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(texts) else 0.0
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    flat, size, tokens, place, owner = _bags(texts)
    bags = len(size)
    hit = np.zeros(BUCKETS, bool)
    hit[flat] = True
    used = np.flatnonzero(hit)
    flat = (np.cumsum(hit, dtype=np.int32) - 1)[flat]
    edges = np.searchsorted(np.cumsum(size), np.arange(0, len(flat) + BLOCK, BLOCK), "left")
    edges = np.unique(np.append(edges[1:-1], [0, bags]))
    at = np.concatenate(([0], np.cumsum(size)))
    blocks = [(slice(a, b), flat[at[a] : at[b]], at[a:b] - at[a]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    passages = len(owner)
    some = np.unique(place)  # passages with words
    starts = np.searchsorted(place, some)
    docs = len(texts)
    cost = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())

    rng = np.random.default_rng(seed)
    p = {"table": rng.normal(0, spread, (dim, len(used))).astype(np.float32), "head": rng.normal(0, 0.3, (2, dim)).astype(np.float32), "bias": np.zeros(2, np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        word = np.empty((dim, bags), np.float32)
        for own, grams, starts_of in blocks:
            for d in range(dim):
                word[d, own] = np.add.reduceat(p["table"][d][grams], starts_of) / size[own]
        passage = np.zeros((dim, passages), np.float32)
        for d in range(dim):
            passage[d, some] = np.add.reduceat(word[d][tokens], starts)
        passage /= PASSAGE
        logits = p["head"] @ passage + p["bias"][:, None]
        gap = logits[1] - logits[0]
        top = np.full(docs, -np.inf)
        np.maximum.at(top, owner, gap)
        share = np.exp(np.clip(gap - top[owner], -50, 0))
        share /= np.bincount(owner, share, docs)[owner]
        doc_logit = np.bincount(owner, share * gap, docs)
        prob = 1 / (1 + np.exp(-np.clip(doc_logit, -30, 30)))
        pull = (cost * (prob - toxic))[owner] * share  # of the loss by a passage's logit gap
        grad_logits = np.stack([-pull, pull]).astype(np.float32)
        g = {"head": grad_logits @ passage.T, "bias": grad_logits.sum(axis=1)}
        by_passage = (p["head"].T @ grad_logits) / PASSAGE
        by_word = np.stack([np.bincount(tokens, by_passage[d][place], bags) / size for d in range(dim)]).astype(np.float32)
        g["table"] = decay / toxic.sum() * p["table"]
        for own, grams, _ in blocks:
            for d in range(dim):
                g["table"][d] += np.bincount(grams, np.repeat(by_word[d, own], size[own]), len(used)).astype(np.float32)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = (p["head"][1] - p["head"][0]) @ p["table"]
    return ToxicityModel(weights, float(p["bias"][1] - p["bias"][0]))


def fit(documents: DataFrame, labels: DataFrame, *, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500, **options) -> ToxicityModel:
    """Trains on at most `per_class` labelled rows of either class, chosen by a hash of the id among those where `learn` holds."""
    picked = labelled_sample(labels if learn is None else labels.where(learn), id_col, label_col, per_class)
    picked = picked.select(F.col(id_col).alias("_id"), F.col("label").alias("_label"))
    docs = project(documents, id_col, text_col)
    # 2 * per_class ids at most: small enough to broadcast whatever the corpus
    rows = docs.join(F.broadcast(picked), docs[id_col] == F.col("_id")).select("_id", text_col, "_label").toPandas()
    rows = rows.sort_values(["_id", "_label", text_col], kind="stable")
    texts, toxic = [t or "" for t in rows[text_col]], rows["_label"].to_numpy() == 1
    del rows
    model = train(texts, toxic, **options)
    del texts
    release_memory()
    return model


def _scored(documents: DataFrame, model: ToxicityModel, text_col: str, cut: float, only_clean: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("_clean", T.BooleanType())]

    def compute(part: Slice) -> list:
        score = shared.value.score(part)
        return [score, (score >= cut).astype(np.int32), score < cut]

    return append(documents, text_col, fields, compute, only_true="_clean" if only_clean else None)


def score(documents: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """id, score and predicted class of every document."""
    return _scored(project(documents, id_col, text_col), model, text_col, cut, False).drop(text_col, "_clean")


def keep_clean(documents: DataFrame, model: ToxicityModel, *, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The documents under the cut, with their own columns."""
    return _scored(documents, model, text_col, cut, True)


def fold(column: str = "doc_id") -> Column:
    """The crc32 of an id as text, modulo 5; labels are learned where it is not 0."""
    return F.crc32(F.col(column).cast("string")) % 5


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents, fit(documents, labels, learn=fold() != 0))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
