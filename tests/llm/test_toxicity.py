import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlink.llm.textkernel import slices
from weftlink.llm.toxicity import GRAMS, PASSAGE, _bucket, fit, fold, keep_clean, op2_toxicity, part_hashes, score, train


def corpus(n, seed, stems=("grubbo", "zarnik")):
    rng = random.Random(0)  # one vocabulary for every corpus
    plain = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rng = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        bad = k % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(stems) + "".join(rng.choice("aeioustrnl") for _ in range(3)))
        texts.append(" ".join(words))
        toxic.append(bad)
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def model():
    return train(*corpus(600, 1))


def probabilities(model, texts):
    return np.concatenate([model.score(p) for p in slices(pa.array(texts, pa.string()))])


def test_held_out_words(model):
    """The suffixes, hence the words, of the second corpus were never seen."""
    texts, toxic = corpus(300, 2)
    got = probabilities(model, texts)
    assert ((got >= 0.5) == toxic).mean() > 0.97
    spoiled = ["Grubb0ist " + texts[1], texts[2] + " zarnnik", texts[3]]
    assert list(probabilities(model, spoiled) >= 0.5)[2] == toxic[3]


def test_score_equals_plain_computation(model):
    texts = ["Grubboeee a É öo", "x " * 30 + "zarnikaa", "", None, " \n ", "one\tone one two", "w" * 4000]

    def gram_row(gram):
        h = np.zeros(1, np.uint64)
        for b in gram:
            h = h * np.uint64(1000003) + np.uint64(b) + np.uint64(1)
        return int(_bucket(h, len(gram))[0])

    def word_logit(word):
        marked = b" " + word + b" "
        part = next(slices(pa.array([word.decode()])))
        whole = int(_bucket(part_hashes(part, part.data, part.starts, part.ends), 0)[0])
        rows = [whole] + [gram_row(marked[i : i + n]) for n in GRAMS for i in range(len(marked) - n + 1)]
        return model.weights[rows].mean(dtype=float)

    for text, got in zip(texts, probabilities(model, texts)):
        words = (text or "").lower().encode().split()
        passages = [words[k : k + PASSAGE] for k in range(0, len(words), PASSAGE)] or [[]]
        worst = max(sum(word_logit(w) for w in set(p)) / PASSAGE + model.bias for p in passages)
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(worst, -30, 30))), abs=1e-5)


def test_frames(spark):
    texts, toxic = corpus(240, 3)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, None, None), (900, "", "y"), (901, texts[0], None), (901, texts[0], None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(toxic)] + [(None, 1), (5000, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    fitted = fit(docs, labels, learn=fold() != 0)
    rows = score(docs, fitted).collect()
    assert len(rows) == 244 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[901] == by_id[0]
    clean = keep_clean(docs, fitted)
    assert clean.columns == docs.columns
    assert clean.count() == sum(r.predicted == 0 for r in rows)
    assert score(docs.limit(0), fitted).count() == 0
    held = docs.select(F.coalesce(fold() == 0, F.lit(False)).alias("h")).where("h is null").count()
    assert held == 0
    nobody = fit(docs, labels.limit(0))
    assert all(r.score < 1e-6 for r in score(docs, nobody).collect())


def test_query(spark, sf_dir):
    rows = op2_toxicity(spark, sf_dir).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
