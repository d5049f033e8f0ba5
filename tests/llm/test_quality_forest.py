import re
from collections import Counter

import numpy as np
import pytest

from weftlink.llm.quality_forest import COUNTS, IsolationForest, fit, judge, keep, op8_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The five counts and the hard verdict of one text, by the letter of the rules."""
    text = text or ""
    words = WORD.findall(text)
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), doubled, len(covered))
    return counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


EDGES = [
    None, "", " \n\t ", "one", "a b c a b c", "x\ny\nx\n x\nx", "é " * 60, "# $ % & | < > *" * 10, "w " * 49, "w " * 50, " ".join(f"w{k}" for k in range(50)), "same line here\n" * 40,
    " ".join(f"w{k}" for k in range(100)) + " w0 w1 w2", "\x0b".join(f"v{k}" for k in range(60)), "\x1c " * 70, "日本 語\r\n日本 語\r\n" * 30, " ".join(f"t{k}" for k in range(60_000)), "y" * 100_000,
]


def test_counts_on_edges(spark):
    rows = [(k, t, k % 2, "own") for k, t in enumerate(EDGES)] + [(None, EDGES[10], 1, None), (3, "one", 0, None), (3, "one", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string").repartition(3)
    labels = spark.createDataFrame([(10, 1), (12, 1), (16, 1), (9, 0), (None, 1), (99, 0), (1, None), (2, 5)], "doc_id long, quality int")
    for model in (fit(docs, labels), fit(docs, labels.limit(0))):
        got = judge(docs, model).collect()
        assert len(got) == len(rows)
        for r in got:
            text = EDGES[10] if r.doc_id is None else "one" if r.doc_id == 3 else EDGES[r.doc_id]
            counts, failed = brute(text)
            assert tuple(r[c] for c in COUNTS) == counts and r.base_failed == failed and not (failed and r.kept)
        assert fit(docs, labels.limit(0)).forest is None
    only = keep(docs, fit(docs, labels.limit(0)))
    assert only.schema == docs.schema and only.count() == sum(not brute(t)[1] for _, t, *_ in rows)
    assert judge(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_driver_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, failed = brute(texts[r.doc_id])
        assert tuple(r[c] for c in COUNTS) == counts and r.base_failed == failed and not (failed and r.kept)


def test_held_out_labels(spark):
    """Fitted on one half of the labels, judged on the other."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    model = fit(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 1"))
    rows = judge(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert len(good) > 500 and len(bad) > 100
    assert np.mean([not r.kept for r in bad]) > 0.97
    assert np.mean([not r.kept and not r.base_failed for r in good]) < 0.01


def path_length(forest, t, row):
    node = 0
    while forest.feature[t, node] >= 0:
        node = 2 * node + 1 + int(np.float32(row[forest.feature[t, node]]) > forest.cut[t, node])
    return forest.depth[t, node]


@pytest.mark.parametrize("seed", range(3))
def test_scores_are_path_lengths(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 3))
    forest = IsolationForest.grow(x, x.min(axis=0) - 4, x.max(axis=0) + 4, trees=20, sample=64, limit=6, seed=seed)
    probe = np.vstack([x[:20], [[4.0, 4.0, 4.0]], x[:1]])
    want = [2 ** (-np.mean([path_length(forest, t, row) for t in range(20)]) / forest.norm) for row in probe]
    got = forest.score(probe)
    assert got == pytest.approx(want, rel=1e-5) and got[20] > got[:20].max() and got[21] == got[0]


def test_every_labelled_row_counts(spark):
    """More good rows than the 6,000 that fitting once stopped at."""
    words = "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', repeat('x', cast(pmod(xxhash64(id, i), 7) as int)), if(pmod(xxhash64(i, id), 20) = 0, '#', ''), i)))"
    docs = spark.range(9000).selectExpr("id as doc_id", f"{words} as text").repartition(5)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 50 <> 7 as int) as quality")
    model = fit(docs, labels)
    rows = judge(docs, model).join(labels, "doc_id").where("not base_failed").collect()
    good = np.sort([r.anomaly for r in rows if r.quality == 1])
    assert len(good) > 8000 and model.threshold == good[len(good) - 1 - int(0.002 * len(good))]
    again = fit(docs.orderBy("text"), labels.repartition(3))
    assert again.threshold == model.threshold and (again.forest.cut == model.forest.cut).all()
