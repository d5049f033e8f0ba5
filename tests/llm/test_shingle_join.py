import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from weftlink.llm.shingle_join import _sketch_gap, parity_sketch, set_simhash


def shingles(text, words=5):
    split = (text or "").encode().lower().split()
    return {b" ".join(split[k : k + words]) for k in range(max(1, len(split) - words + 1))} if split else set()


def brute_groups(texts, share=0.8):
    """Smallest id of each group by comparing every pair."""
    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in texts:
        for j in texts:
            a, b = sorted((len(sets[i]), len(sets[j])))
            if i < j and 5 * a >= 4 * b and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in texts}


def near_copies():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = {}
    for k in range(60):
        base = [word() for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = word()
            texts[len(texts)] = "one very common line of words " * (k % 3 == 0) + " ".join(own)
    return texts | {900: "", 901: None, 902: "A b", 903: "a  B"}


def test_sketches_never_exceed_the_difference(spark):
    """The bits in which two parity sketches differ are at most the members that two sets do not share."""
    rng = np.random.default_rng(2)
    rows = []
    for n in (0, 1, 63, 64, 65, 200, 700, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.1, 0.3):
            kept = a[rng.random(len(a)) >= share]
            b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, len(a) - len(kept) + 3, dtype=np.uint64)]))
            rows.append((parity_sketch(a).tolist(), parity_sketch(b).tolist(), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, apart int").select("apart", _sketch_gap(F.col("x"), F.col("y")).alias("gap"))
    got = df.collect()
    assert all(r.gap <= r.apart for r in got) and sum(r.gap > r.apart / 3 for r in got) > len(got) / 2


def test_set_simhash_is_the_majority():
    values = np.random.default_rng(0).integers(0, 1 << 63, 31, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in values) > len(values))
    assert set_simhash(values) & (1 << 64) - 1 == want and set_simhash(values[:0]) == 0


def test_stage_takes_80_percent_of_five_words(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    label = brute_groups(texts)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {i for i in texts if label[i] == i}


def test_posts_are_shuffled_once(spark, monkeypatch):
    """Heads and the posts they meet, and both sides of the last join, come from one shuffle each: reading it twice is no more disk."""
    import weftlink.llm.shingle_join as J

    plans, cut = [], J.cut

    def noted(df):
        found = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(J, "cut", noted)
    # most pairs share single words and stay in two groups up to the last join
    rng = random.Random(3)
    texts = [" ".join(f"w{n}" for n in rng.sample(range(60), 30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dict(J.similar_groups(df, words=1, percent=60).collect())
    assert len(found) == 40
    heads, rest = [p for p in plans if "posexplode" in p], [p for p in plans if "bit_count" in p and "bt#" in p]
    assert len(heads) == len(rest) == 1
    assert ["ReusedExchange" in p.split("Initial Plan")[0] for p in heads + rest] == [True, True], rest
