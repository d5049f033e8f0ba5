"""Quality rules (operator 8): hard rules plus an isolation forest on rule statistics.

Every document gets the same statistics a rule set would test. Hard rules reject outright; an isolation
forest gives each of the others a path length. Its trees are grown from random splits, each over the rows that the method draws
for it from all rows labelled good. The verdict threshold is calibrated on every labelled row: the cut with the most true
rejections among those that reject at most `max_clean_loss` of the rows labelled good.

Defined results: null, empty and blank texts have zero statistics and fail the base rules; repeated ids
and rows are judged one by one; an empty table gives no rows; without usable labels only the hard rules
reject. Texts are read whole. Columns other than the id and the text never reach the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import with_position
from ..session import cut, table
from .frames import append, project, release_memory
from .textkernel import INK, Slice, mix

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ODD = np.ones(256, bool)
_ODD[ord("a") : ord("z") + 1] = False
_ODD[128:] = False


def _repeated_words(part: Slice) -> np.ndarray:
    """For each row, the words that lie in a three-word window found twice or more in that row."""
    n = len(part.starts)
    if n < 3:
        return np.zeros(part.n, np.int64)
    row, h = part.word_row(), part.word_hashes()
    inside = row[2:] == row[:-2]
    key = mix(mix(mix(h[:-2]) * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])
    key = mix(key + row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]] if len(order) else np.zeros(0, bool)
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return np.bincount(row[covered], minlength=part.n)


def _dup_lines(part: Slice) -> np.ndarray:
    """For each row, its lines with a word that equal an earlier one."""
    breaks = np.flatnonzero(part.data == 0x0A)
    row = np.concatenate((np.arange(part.n), np.searchsorted(part.rows, breaks, "right") - 1))
    at = np.concatenate((part.rows[:-1], breaks + 1))
    order = np.lexsort((at, row))
    row, starts = row[order], at[order]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = np.where(row[1:] == row[:-1], starts[1:] - 1, part.rows[row[:-1] + 1])
    ends[-1:] = part.rows[-1]
    ink = np.concatenate(([0], np.cumsum(INK[part.data], dtype=np.int64)))
    used = np.flatnonzero(ink[ends] > ink[starts])
    key, owner = part.hashes(starts[used], ends[used]), row[used]
    order = np.lexsort((key, owner))
    again = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner[order][1:][again], minlength=part.n)


def statistics(part: Slice) -> dict[str, np.ndarray]:
    data = part.data
    closing = np.zeros(len(data), bool)
    closing[part.ends - 1] = True
    return {
        "n_words": np.diff(part.word_rows),
        "word_chars": part.per_row(INK[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": part.per_row(_SYMBOL[data]),
        "n_dup_lines": _dup_lines(part),
        "n_repeat_words": _repeated_words(part),
        "n_odd_ends": part.per_row(closing & _ODD[data]),  # words that end in neither a lower-case letter nor a non-ASCII byte
    }


FEATURES = ("mean_word_length", "symbol_ratio", "repeat_word_ratio", "odd_end_ratio")


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics as ratios, so that length alone isolates nobody."""
    words = np.maximum(s["n_words"], 1)
    return np.column_stack([s["word_chars"] / words, s["n_symbols"] / words, s["n_repeat_words"] / words, s["n_odd_ends"] / words])


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Arrays of trees in heap order: node i has children 2i+1 and 2i+2; feature -1 marks a leaf.

    Cuts are drawn from a node's whole box, which starts as the range of all labelled rows, not from the
    range of the rows that are left in it: a row outside the dense regions falls into an empty box early.
    """

    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    depth: np.ndarray  # path length that ends at the node, with the expected rest for a full leaf
    norm: float

    @staticmethod
    def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 150, sample: int = 128, limit: int = 10, seed: int = 0, picks: list[np.ndarray] | None = None) -> IsolationForest:
        """Each tree from `sample` rows of x, or from those that `picks` names for it."""
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x)) if picks is None else len(picks[0])
        nodes = 2 ** (limit + 1) - 1
        feature = np.full((trees, nodes), -1, np.int16)
        cut = np.zeros((trees, nodes), np.float32)
        depth = np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            todo = [(0, x[rng.choice(len(x), sample, replace=False) if picks is None else picks[t]], low, high, 0)]
            while todo:
                node, part, a, b, level = todo.pop()
                open_ = np.flatnonzero(b > a)
                if level >= limit or len(part) <= 1 or not len(open_):
                    depth[t, node] = level + _expected_path(len(part))
                    continue
                f = rng.choice(open_)
                at = rng.uniform(a[f], b[f])
                left = part[:, f] <= at
                feature[t, node], cut[t, node] = f, at
                upper, lower = b.copy(), a.copy()
                upper[f] = lower[f] = at
                todo += [(2 * node + 1, part[left], a, upper, level + 1), (2 * node + 2, part[~left], lower, b, level + 1)]
        return IsolationForest(feature, cut, depth, float(_expected_path(sample)) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 to the power of minus the mean path over its norm."""
        x = x.astype(np.float32)
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            live = np.arange(len(x))
            while len(live):
                f = self.feature[t, node[live]]
                live, f = live[f >= 0], f[f >= 0]
                here = node[live]
                node[live] = 2 * here + 1 + (x[live, f] > self.cut[t, here])
            total += self.depth[t, node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


@dataclass
class QualityModel:
    forest: IsolationForest | None
    threshold: float  # rows with a higher score are rejected

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(x) if self.forest else np.zeros(len(x))


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_clean_loss: float = 0.002, trees: int = 150, sample: int = 128, seed: int = 0) -> QualityModel:
    """Grows the forest on labelled-good rows and calibrates its cut on both classes.

    Every labelled row counts: for the box that cuts are drawn from, among the rows a tree draws, and for the threshold, an exact order
    statistic. Only statistics are joined and sorted, and `trees * sample` rows of four numbers at most come to the driver.
    """
    use = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    fields = [T.StructField(n, T.DoubleType()) for n in FEATURES] + [T.StructField("failed", T.BooleanType())]

    def compute(part: Slice) -> list:
        s = statistics(part)
        return [*features(s).T, base_failed(s)]

    every = append(project(documents, id_col, text_col), text_col, fields, compute).drop(text_col)
    rows = cut(every.join(use, F.col(id_col) == F.col("_id")).where(~F.col("failed")).select("_label", *FEATURES))
    ends = [f(n).alias(f"{n}_{e}") for e, f in (("low", F.min), ("high", F.max)) for n in FEATURES]
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_label") == 1).alias("good"), *ends).first()
    n = found.good
    if n < 2 or n == found.n:
        return QualityModel(None, 1.0)
    low, high = (np.array([found[f"{c}_{e}"] for c in FEATURES]) for e in ("low", "high"))
    good = rows.where("_label = 1").select(*FEATURES)
    tied = lambda df: df.withColumn("_tie", F.monotonically_increasing_id())  # noqa: E731  equal rows may be in any order, but in several tasks
    rng = np.random.default_rng(seed)
    picks = [rng.choice(n, min(sample, n), replace=False) for _ in range(trees)]
    places = np.unique(np.concatenate(picks))
    # by place in the order of the statistics: the same forest whatever order the rows came in
    drawn = rows.sparkSession.createDataFrame([(p,) for p in places.tolist()], "_position long")
    x = with_position(tied(good), *FEATURES, "_tie").join(F.broadcast(drawn), "_position").orderBy("_position").select(*FEATURES).toPandas().to_numpy(float)
    forest = IsolationForest.grow(x, low, high, trees, sample, seed=seed, picks=[np.searchsorted(places, p) for p in picks])
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(x), pa.float64())], names=["score"])

    place = n - 1 - int(max_clean_loss * n)  # the lowest cut that rejects at most so many of the good rows
    model = QualityModel(forest, with_position(tied(good.mapInArrow(score, "score double")), "score", "_tie").where(F.col("_position") == place).first().score)
    release_memory()
    return model


_RESULT = [*(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]


def _judge(documents: DataFrame, model: QualityModel, text_col: str, only_kept: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def compute(part: Slice) -> list:
        s = statistics(part)
        failed, score = base_failed(s), shared.value.score(features(s))
        return [*(s[n] for n in COUNTS), failed, score, ~failed & (score <= shared.value.threshold)]

    return append(documents, text_col, _RESULT, compute, only_true="kept" if only_kept else None)


def judge(documents: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, hard-rule verdict, anomaly score and final verdict of every document."""
    return _judge(project(documents, id_col, text_col), model, text_col, False).drop(text_col)


def keep(documents: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns."""
    return _judge(documents, model, text_col, True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(documents, fit(documents, labels))


COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
 g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g), (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
 c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of `op8_quality_rules` that SQL can state: the base counts and the hard verdict."""
    return judge(table(spark, sf_dir, "documents"), QualityModel(None, 1.0)).select("doc_id", *COUNTS, "base_failed")
