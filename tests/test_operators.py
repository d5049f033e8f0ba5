import hashlib
import json
import math
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlink.functions import text as T
from weftlink.operators import blocking, metrics, sampling, scoring, supervision, validate
from weftlink.operators.components import connected_components
from weftlink.operators.features import FEATURE_NAMES, extract
from weftlink.operators.ivfpq import IvfPq, dense_channel, ivfpq_topk, lists, subspaces
from weftlink.operators.retrieval import candidate_union, dense_topk, fill_dense, fill_sparse, gram_text, gram_vectors, lexical_weights, sparse_topk, tfidf_vocabulary


# ---- text --------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_normalize_is_the_plain_rule(text):
    folded = unicodedata.normalize("NFKC", text).casefold()
    want = " ".join("".join(c if c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in folded).split())
    assert T.normalize_text(text) == want


def test_transliteration():
    for given_text, want in [("Étoile", "Etoile"), ("straße", "strasse"), ("Москва", "Moskva"), ("αθηνα", "athena"), ("गणेश", "gannesha"), ("١٢", "12"), ("plain", "plain"), ("日本", "")]:
        assert T.transliterate(given_text) == want
    assert T.normalize_text("श्री गणेश") == "श्री गणेश"


def test_views_and_serialization(spark):
    df = spark.createDataFrame([("a", "Étoile", "", "FR"), ("b", "", "", ""), ("c", "श्री", "12 x", "IN")], "id string, business_name string, business_address string, country string")
    rows = {r.id: r for r in T.with_views(df).collect()}
    assert rows["a"].raw == "Name: Étoile | Country: FR" and rows["a"].normalized == "name étoile country fr" and rows["a"].latin == "name etoile country fr"
    assert rows["b"].raw == rows["b"].normalized == rows["b"].latin == ""
    assert "श्री" in rows["c"].normalized and rows["c"].latin != rows["c"].normalized


def test_token_functions(spark):
    df = spark.createDataFrame([("a b a", "b c", "x12 y١٢ 12", ""), ("", "b", "", "7")], "a string, b string, n string, m string")
    rows = df.select(
        T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))).alias("j"), T.numbers(F.col("n")).alias("n"), T.exact(F.col("a"), F.col("a")).alias("e"), T.char_grams(F.col("b")).alias("g"), T.has_non_ascii(F.col("n")).alias("u"), T.sequence_ratio("a", "b").alias("s")
    ).collect()
    assert rows[0].j == pytest.approx(1 / 3) and rows[0].n == ["12", "١٢"] and rows[0].e == 1 and rows[0].g == ["b c"] and rows[0].u
    assert rows[0].s == SequenceMatcher(None, "a b a", "b c").ratio()
    assert rows[1].j == 0 and rows[1].e == 0 and rows[1].g == [] and rows[1].n == [] and rows[1].s == 0


def test_hash_vectors(spark):
    texts = ["name étoile", "ab", "", "श्री गणेश", "aaaaaa"]

    def plain(text):
        v = np.zeros(64)
        for g in [text[i : i + 3] for i in range(len(text) - 2)] or [text]:
            key = int(hashlib.sha256(json.dumps(g, ensure_ascii=False).encode()).hexdigest()[:16], 16)
            v[key % 64] += 1 if key & 256 else -1
        return v / max(np.linalg.norm(v), 1e-9)

    df = spark.createDataFrame(list(enumerate(texts)), "id int, normalized string")
    got = {r.id: r.embedding for r in T.hash_vectors(df, "id", "normalized").collect()}
    for k, text in enumerate(texts):
        assert np.allclose(got[k], plain(text), atol=1e-6)


# ---- sampling ----------------------------------------------------------------------------------------------


def plain_rank(i, seed, salt):
    return hashlib.sha256(json.dumps([seed, salt, i], ensure_ascii=False).encode()).hexdigest()


def test_sample(spark):
    ids = [f"S1-{k}" for k in range(1000)] + ['q"uote', "bäck\\slash"]
    df = spark.createDataFrame([(i,) for i in ids], "entity_id string").repartition(7)
    for percent, seed in ((1.0, 42), (0.01, 42), (10, 7)):
        size = math.ceil(len(ids) * percent / 100)
        want = set(sorted(ids, key=lambda i: (plain_rank(i, seed, "sample"), i))[:size])
        assert {r[0] for r in sampling.select(df, percent, seed).collect()} == want
    for percent in (0, -1, 101):
        with pytest.raises(ValueError):
            sampling.sample_size(10, percent)
    assert sampling.select(df.limit(0), 5, 1).count() == 0


def test_splits(spark):
    assert sampling.split_sizes(100) == [70, 10, 10, 10] and sampling.split_sizes(50) == [35, 5, 5, 5] and sum(sampling.split_sizes(13)) == 13 and sampling.split_sizes(1) == [1, 0, 0, 0]
    ids = [f"S1-{k}" for k in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "entity_id string")
    order = sorted(ids, key=lambda i: (plain_rank(i, 42, "split"), i))
    want = dict(zip(order, ["fit"] * 35 + ["dev"] * 5 + ["calibration"] * 5 + ["audit"] * 5))
    assert {r.entity_id: r.split for r in sampling.split_groups(df.repartition(5), 42).collect()} == want
    halves = sampling.calibration_halves(df.limit(5), 42).groupBy("half").count().collect()
    assert {r.half: r["count"] for r in halves} == {"probability": 2, "policy": 3}
    with pytest.raises(ValueError):
        sampling.calibration_halves(df.limit(1), 42)


# ---- retrieval ---------------------------------------------------------------------------------------------


def unit(rng, n, d=16):
    v = rng.normal(size=(n, d)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def side(spark, vectors, prefix, key, source=None):
    rows = [(f"{prefix}{k:04d}", *([source] if source else []), [float(x) for x in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} string, {'source int, ' if source else ''}embedding array<float>")


def test_dense_topk(spark, monkeypatch):
    import weftlink.operators.retrieval as R

    rng = np.random.default_rng(0)
    q, t = unit(rng, 30), unit(rng, 100)
    t[50] = t[3]  # a tie
    targets = side(spark, t[:60], "S2-", "tid", 2).unionByName(side(spark, t[60:], "S3-", "tid", 3)).repartition(5)
    want = set()
    for i, v in enumerate(q.astype(float)):
        for source, lo, hi in ((2, 0, 60), (3, 60, 100)):
            scores = [(-round(float(v @ t[k].astype(float)), 6), f"S{source}-{k - lo:04d}") for k in range(lo, hi)]
            want |= {(f"q{i:04d}", tid, source, r + 1) for r, (_, tid) in enumerate(sorted(scores)[:7])}
    for rows in ((4096, 1 << 15), (8, 16)):
        monkeypatch.setattr(R, "DENSE_BLOCK", rows)
        got = dense_topk(side(spark, q, "q", "qid"), targets, 7).collect()
        assert {(r.qid, r.tid, r.source, r.dense_rank) for r in got} == want
    few = dense_topk(side(spark, q, "q", "qid"), targets.where("tid < 'S2-0003'"), 7)
    assert few.count() == 30 * 3
    assert dense_topk(side(spark, q, "q", "qid"), targets.limit(0), 7).count() == 0
    assert dense_topk(side(spark, q, "q", "qid").limit(0), targets, 7).count() == 0


def test_compressed_search(spark):
    rng = np.random.default_rng(42)
    vectors = unit(rng, 512)
    targets, queries = side(spark, vectors, "S2-", "tid", 2), side(spark, vectors, "S2-", "qid")
    options = dict(ivf_nlist=2, pq_m=4, nprobe=2, train_rows=512)
    found = ivfpq_topk(queries, targets, 10, **options).collect()
    assert np.mean([r.tid == r.qid for r in found if r.dense_rank == 1]) > 0.95
    exact = {(r.qid, r.tid) for r in dense_topk(queries, targets, 10).collect()}
    fine = {(r.qid, r.tid) for r in ivfpq_topk(queries, targets, 10, ivf_nlist=8, pq_m=16, nprobe=8, train_rows=512).collect()}
    assert len(exact & fine) / len(exact) >= 0.9
    assert found == ivfpq_topk(queries, targets, 10, **options).collect()
    with pytest.raises(ValueError):
        ivfpq_topk(queries, targets, 5, train_rows=100)
    assert subspaces(64, 32) == 32 and subspaces(10, 4) == 2 and lists(512, 1024) == 12 and lists(3, 9) == 1
    assert dense_channel(queries, targets, 3, exact_limit=1000).count() == 512 * 3


def test_stored_index(spark, tmp_path, monkeypatch):
    """Built once, opened again, with a hot cell that is split over blocks."""
    import weftlink.operators.ivfpq as I

    rng = np.random.default_rng(3)
    vectors = np.concatenate([unit(rng, 400), unit(rng, 1).repeat(300, axis=0) + rng.normal(0, 0.02, (300, 16)).astype(np.float32)])
    targets, queries = side(spark, vectors, "S2-", "tid", 2), side(spark, vectors[::10], "q", "qid")
    options = dict(ivf_nlist=12, pq_m=16, train_rows=700)
    whole = IvfPq.build(targets, **options, path=str(tmp_path / "index")).search(queries, 10, 6).collect()
    again = IvfPq.open(spark, str(tmp_path / "index"))
    assert again.codes.count() == 700 and again.codes.groupBy("cell").count().agg(F.max("count")).first()[0] >= 250
    assert sorted(again.search(queries, 10, 6).collect()) == sorted(whole)
    monkeypatch.setattr(I, "CELL_BLOCK", (7, 50))
    assert sorted(again.search(queries, 10, 6).collect()) == sorted(whole)
    exact = {(r.qid, r.tid) for r in dense_topk(queries, targets, 10).collect()}
    assert len(exact & {(r.qid, r.tid) for r in whole}) / len(exact) >= 0.9


def test_sparse_channel_and_union(spark, monkeypatch):
    import weftlink.operators.retrieval as R

    texts = {"S2-a": "name red house", "S2-b": "name blue house", "S2-c": "zz", "S3-a": "name red horse", "S3-b": "other text here"}
    queries = {"q1": "name red house", "q2": "qq qq", "q3": ""}
    t = spark.createDataFrame([(k, int(k[1]), v) for k, v in texts.items()], "tid string, source int, lexical string")
    q = spark.createDataFrame(list(queries.items()), "qid string, lexical string")
    grams = lambda s: [s[i : i + 3] for i in range(len(s) - 2)]
    want = {}
    for source in (2, 3):
        own = {k: v for k, v in texts.items() if int(k[1]) == source}
        df = {g: sum(g in grams(v) for v in own.values()) for v in own.values() for g in grams(v)}
        idf = {g: math.log((1 + len(own)) / (1 + n)) + 1 for g, n in df.items()}

        def vec(s, idf=idf):
            w = {g: grams(s).count(g) * idf[g] for g in set(grams(s)) if g in idf}
            norm = math.sqrt(sum(x * x for x in w.values())) or 1
            return {g: x / norm for g, x in w.items()}

        for qid, s in queries.items():
            for tid, v in own.items():
                a, b = vec(s), vec(v)
                want[qid, tid] = round(sum(x * b.get(g, 0) for g, x in a.items()), 6)
    qw, tw = lexical_weights(q, t)
    got = {(r.qid, r.tid): (r.tfidf_score, r.tfidf_rank) for r in sparse_topk(qw, tw, 2).collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v for k, v in want.items() if v > 0})
    assert got["q1", "S2-a"][1] == 1 and got["q1", "S2-b"][1] == 2
    monkeypatch.setattr(R, "SPARSE_BLOCK", (1, 1))
    assert {k: v[0] for k, v in got.items()} == {(r.qid, r.tid): r.tfidf_score for r in sparse_topk(qw, tw, 2).collect()}
    vocabulary = tfidf_vocabulary(gram_vectors(t, "tid"), max_features=3)
    assert vocabulary.count() == 6
    assert {r.g for r in tfidf_vocabulary(gram_vectors(t, "tid")).select(gram_text(F.col("gram")).alias("g")).collect()} == {g for v in texts.values() for g in grams(v)}
    bare = t.withColumn("lexical", F.lit("ab"))  # no text of a source has a trigram
    assert sparse_topk(*lexical_weights(q, bare), 2).count() == 0 and sparse_topk(*lexical_weights(q.limit(0), t), 2).count() == 0

    rng = np.random.default_rng(1)
    qe = q.join(side(spark, unit(rng, 3), "x", "k").selectExpr("concat('q', int(substring(k, 2, 4)) + 1) as qid", "embedding"), "qid")
    te = t.join(spark.createDataFrame([(k, [float(x) for x in v]) for k, v in zip(texts, unit(rng, 5))], "tid string, embedding array<float>"), "tid")
    pairs = candidate_union(dense_topk(qe, te, 1), sparse_topk(qw, tw, 1))
    full = fill_sparse(fill_dense(pairs, qe, te), qw, tw).collect()
    assert all(r.dense_score is not None and r.tfidf_score == pytest.approx(want[r.qid, r.tid]) for r in full)
    assert len(full) == len({(r.qid, r.tid) for r in full}) and {tuple(r.channels) for r in full} <= {("dense",), ("tfidf",), ("dense", "tfidf")}


@pytest.mark.parametrize("seed", [0, 1])
def test_sparse_search_equals_plain_products(seed):
    """Frequent and rare grams, ties, and rows without a common gram."""
    import pyarrow as pa

    from weftlink.operators.retrieval import _sparse_search

    rng = np.random.default_rng(seed)
    make = lambda n: [(g := np.unique(np.concatenate([np.flatnonzero(rng.random(5) < 0.8), rng.integers(5, 400, rng.integers(0, 12))])).astype(np.int64), rng.random(len(g)) + 0.1) for _ in range(n)]
    left, right = make(40), make(90) + [(np.array([10_000]), np.array([1.0]))]
    right[7] = right[3]
    table = lambda rows, key: pa.table({key: [f"{key}{k:03d}" for k in range(len(rows))], "source": pa.array([2] * len(rows), pa.int32()), "grams": [g.tolist() for g, _ in rows], "weights": [w.tolist() for _, w in rows]})
    found = _sparse_search(table(left, "qid"), table(right, "tid"), 5, "s")
    got = set(zip(found["qid"].to_pylist(), found["tid"].to_pylist(), found["s"].to_pylist()))
    want = set()
    for i, (g, w) in enumerate(left):
        scores = [(-round(float(sum(x * v[list(h).index(a)] for a, x in zip(g, w) if a in h)), 6), j) for j, (h, v) in enumerate(right)]
        want |= {(f"qid{i:03d}", f"tid{j:03d}", -s) for s, j in sorted(scores)[:5] if s < 0}
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want} and sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in want))


def test_blocking_is_exact_for_frequent_tokens(spark):
    """A token that 60 of 64 targets hold still ranks them; one that all hold weighs nothing."""
    t = spark.createDataFrame([(f"t{k:03d}", 2, ["all", *(["most"] if k < 60 else []), f"own{k % 10}"]) for k in range(64)], "tid string, source int, tokens array<string>")
    q = spark.createDataFrame([("a", ["all", "most"]), ("b", ["all", ""]), ("c", ["own3", "most", "own3"]), ("d", [])], "qid string, tokens array<string>")
    got = {}
    for r in blocking.token_blocking(q, t, 4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.tid, r.weight))
    most, own = round(math.log(64 / 60), 6), [k for k in range(64) if k % 10 == 3]
    assert got == {"a": [(f"t{k:03d}", most) for k in range(4)], "c": [(f"t{k:03d}", pytest.approx(math.log(64 / 60) + math.log(64 / len(own)), abs=2e-6)) for k in own[:4]]}
    names = blocking.exact_name_blocking(spark.createDataFrame([("a", "x"), ("b", "")], "qid string, name string"), spark.createDataFrame([(f"t{k}", 2, "x" if k % 2 else "") for k in range(9)], "tid string, source int, name string"), 3)
    assert [(r.qid, r.tid, r.rank) for r in names.orderBy("rank").collect()] == [("a", "t1", 1), ("a", "t3", 2), ("a", "t5", 3)]


# ---- features, supervision, scoring ------------------------------------------------------------------------


def test_features(spark):
    fields = "business_name string, business_address string, country string"
    q = spark.createDataFrame([("q", "Étoile bakery", "42 Rue", "FR"), ("r", "x", "", "FR")], f"qid string, {fields}")
    t = spark.createDataFrame([("t", "étoile  Bakery!", "42, rue", "fr"), ("u", "", "", "")], f"tid string, {fields}")
    pairs = spark.createDataFrame([("q", "t", 0.5, 0.25), ("r", "u", -1.0, 0.0)], "qid string, tid string, dense_score double, tfidf_score double")
    rows = {r.qid: [r[n] for n in FEATURE_NAMES] for r in extract(pairs, q, t).collect()}
    assert len(FEATURE_NAMES) == 22
    assert rows["q"] == [0.5, 0.25] + [1.0, 1.0, 1.0, 1.0, 0.0, 0.0] * 3 + [1.0, 1.0]
    assert rows["r"] == [-1.0, 0.0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0]


def test_leakage_and_training_sets(spark):
    truth = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("a", "t2")], "qid string, tid string")
    splits = spark.createDataFrame([("a", "fit"), ("b", "audit"), ("c", "dev")], "qid string, split string")
    pairs = spark.createDataFrame([(q, t, 2, k + 1) for q in "abc" for k, t in enumerate(["t1", "t2", "t3", "t4"])], "qid string, tid string, source int, tfidf_rank int")
    got = {(r.qid, r.tid): r.label for r in supervision.supervised_pairs(pairs, truth, splits).collect()}
    assert ("a", "t2") not in got and got[("a", "t1")] == 1 and got[("b", "t2")] == 1 and got[("c", "t2")] == 0
    negatives = supervision.hard_negatives(pairs, truth, splits, 1)
    assert {(r.qid, r.tid) for r in negatives.collect()} == {("a", "t3"), ("c", "t1")}
    examples = supervision.training_examples(truth, negatives, splits, 1, [F.col("tid")]).collect()
    assert {(r.qid, r.tid, r.label) for r in examples} == {("a", "t1", 1), ("a", "t3", 0), ("c", "t1", 0)}


def test_routing(spark):
    rows = list(enumerate(zip([0.1, 0.9, 0.5, 0.5, 0.2, 0.8], [1.0, 0.0, 0.75, 0.6, 0.7, 0.7])))
    df = spark.createDataFrame([(str(k), "t", x, c) for k, (x, c) in rows], "qid string, tid string, x double, c0 double")
    done = {r.qid: r for r in scoring.decide(df, 0.2, 0.8, 0.7, lambda d: d.withColumn("c", F.col("c0"))).collect()}
    assert [done[str(k)].accepted for k in range(6)] == [False, True, True, False, True, True]
    assert [done[str(k)].routed for k in range(6)] == [False, False, True, True, True, True]
    assert done["0"].c is None and done["2"].c == 0.75
    with pytest.raises(ValueError):
        scoring.decide(df, 0.2, 0.8, 0.7).collect()


@pytest.mark.parametrize("positives,predicted,tp,want", [(0, 0, 0, 1), (0, 1, 0, 0), (2, 1, 1, 1.25 / 1.5), (1, 2, 1, 1.25 / 2.25), (2, 0, 0, 0)])
def test_entity_f(spark, positives, predicted, tp, want):
    assert spark.range(1).select(scoring.entity_f(*[F.lit(x) for x in (tp, predicted, positives)])).first()[0] == pytest.approx(want)


def test_isotonic(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(x), int(y)) for x, y in zip(np.round(rng.random(80), 1), rng.random(80) > 0.5)], "x double, label int")
    knots = scoring.isotonic_knots(df, "x")
    fitted = {r.x: r.fit for r in scoring.isotonic_by_blocks(df, "x").collect()}
    got = {r.x: r.y for r in df.select("x").distinct().withColumn("y", scoring.isotonic_apply(F.col("x"), knots)).collect()}
    assert got == pytest.approx(fitted)
    ends = spark.createDataFrame([(-5.0,), (9.0,), (0.05,)], "x double").select(scoring.isotonic_apply(F.col("x"), knots)).collect()
    assert ends[0][0] == knots[0][1] and ends[1][0] == knots[-1][1] and ends[2][0] == pytest.approx(np.interp(0.05, *zip(*knots)))


def test_policies(spark):
    assert len(scoring.policy_values(15)) == 17 and scoring.policy_grid(spark, 15).count() == 2312 and scoring.policy_grid(spark, 5).count() == 147
    scored = spark.createDataFrame([("a", "t1", 0.9, 0.1, 1), ("a", "t2", 0.5, 0.9, 0), ("b", "t3", 0.4, 0.8, 1)], "qid string, tid string, x double, c double, label int")
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "qid string")
    truth = spark.createDataFrame([("a", "t1"), ("b", "t3"), ("b", "t9"), ("d", "t7")], "qid string, tid string")
    for r in scoring.evaluate_policies(scored, entities, truth, scoring.policy_grid(spark, 5)).collect():
        f = tp = predicted = routed = 0
        for q, want in (("a", {"t1"}), ("b", {"t3", "t9"}), ("c", set()), ("d", {"t7"})):
            rows = [s for s in scored.collect() if s.qid == q]
            hit = [s for s in rows if s.x > r.upper or (r.lower <= s.x <= r.upper and s.c >= r.acceptance)]
            good = sum(s.label for s in hit)
            f += float(not hit) if not want else 1.25 * good / (0.25 * len(want) + len(hit))
            tp, predicted, routed = tp + good, predicted + len(hit), routed + sum(r.lower <= s.x <= r.upper for s in rows)
        assert (r.f, r.tp, r.predicted, r.routed) == (pytest.approx(f), tp, predicted, routed)


def test_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 22))
    rows = [(str(k), "t", *[float(v) for v in r], int(r[3] + r[9] > 1)) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["qid", "tid", *FEATURE_NAMES, "label"])
    model, best = scoring.fit_gbt(df.where("qid < '5'"), df.where("qid >= '5'"), trees=8, depth=3, patience=3, step=4)
    assert 1 <= best <= 8
    scored = scoring.gbt_scores(model, df).collect()
    assert all(0 <= r.x <= 1 for r in scored) and np.mean([(r.x > 0.5) == (r.label == 1) for r in scored]) > 0.85


# ---- metrics, blocking, checks -----------------------------------------------------------------------------


def test_metrics(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "qid string")
    truth = spark.createDataFrame([("a", "t1", 2), ("a", "t2", 3)], "qid string, tid string, source int")
    decided = spark.createDataFrame([("a", "t1", 2, True, False), ("a", "t2", 3, False, True), ("b", "t1", 2, True, False)], "qid string, tid string, source int, accepted boolean, routed boolean")
    items = {r.qid: r for r in metrics.entity_metrics(entities, truth, decided).collect()}
    assert (items["a"].tp, items["a"].predicted, items["a"].candidate_hits, items["a"].f) == (1, 1, 2, pytest.approx(1.25 / 1.5))
    assert items["b"].f == 0 and items["c"].f == 1
    total = metrics.rollup(metrics.entity_metrics(entities, truth, decided)).first()
    assert (total.entities, total.precision, total.recall, total.candidate_pair_recall, total.routed) == (3, 0.5, 0.5, 1.0, 1)
    by = {r.source: r for r in metrics.by_source(entities, truth, decided, [2, 3]).collect()}
    assert by[2].tp == 1 and by[2].positives == 1 and by[3].tp == 0 and by[3].macro_f05 == pytest.approx(2 / 3)


def test_checks(spark):
    records = spark.createDataFrame([("S1-1", 1), ("S1-2", 1), ("S2-1", 2), ("S3-1", 3)], "id string, source int")
    lists_ = spark.createDataFrame([("S1-1", "S2-1,S3-1", "S2-1"), ("S1-2", "", "")], "qid string, candidates string, matches string")
    assert validate.list_violations(lists_, records).count() == 0 and validate.uncovered(lists_, records).count() == 0
    for bad, problem in [(("S1-1", "S2-1", "S3-1"), "outside_candidates"), (("S1-1", "S2-1,S2-1", ""), "bad_target_ids"), (("S9-1", "", ""), "unknown_query"), (("S1-1", "S1-2", ""), "unknown_target")]:
        found = validate.list_violations(spark.createDataFrame([bad], lists_.schema), records)
        assert problem in {r.problem for r in found.collect()}
    assert validate.list_violations(lists_.union(lists_), records).where("problem = 'duplicate_query'").count() == 2
    assert validate.uncovered(lists_.limit(1), records).collect()[0].side == "left"
    with pytest.raises(ValueError):
        validate.require(validate.bad_ids(spark.createDataFrame([("a,b",)], "id string"), "id"), "invalid id")


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 150: 100, **{k: 500 for k in range(500, 560)}}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_blocking(spark):
    ranked = spark.createDataFrame([("q", 2, "a", "d", 1), ("q", 2, "b", "d", 2), ("q", 2, "b", "s", 1)], "qid string, source int, tid string, channel string, rank int")
    assert [r.tid for r in blocking.reciprocal_rank_fusion(ranked).orderBy("rank").collect()] == ["b", "a"]
    a, b = (spark.createDataFrame([("q", t, k + 1) for k, t in enumerate(x)], "qid string, tid string, rank int") for x in ("abc", "bde"))
    assert [r.tid for r in blocking.interleave(a, b, 4).orderBy("rank").collect()] == ["a", "b", "d", "c"]
    scripts = spark.createDataFrame([("Étoile",), ("गणेश 12",), ("12",), ("Москва",)], "t string").select(blocking.script(F.col("t")).alias("s")).collect()
    assert [r.s for r in scripts] == ["latin", "indic", "none", "other"]
    q, t = (spark.createDataFrame([(k, k)], f"{n} string, text string") for k, n in (("abc", "qid"), ("गणेश", "tid")))
    pair = spark.createDataFrame([("abc", "गणेश")], "qid string, tid string")
    row = blocking.script_mismatch(pair, q, t, pair.limit(0)).first()
    assert (row.retrieved, row.pairs, row.mismatched) == (False, 1, 1)
    once = blocking.distinct_texts(q.union(q), "text", lambda d: d.withColumn("n", F.length("text")))
    assert [r.n for r in once.collect()] == [3, 3]


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    """Searches read stored blocks again instead of dealing each row once for each block it meets; what is stored is less than the texts."""
    import weftlink.operators.retrieval as R
    from weftlink.operators.blocks import from_bytes, meet

    monkeypatch.setattr(R, "SPARSE_BLOCK", (8, 16))
    monkeypatch.setattr(R, "DENSE_BLOCK", (8, 16))
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(60)]
    t = spark.createDataFrame([(f"t{k:02d}", 2 + k % 2, x) for k, x in enumerate(texts)], "tid string, source int, lexical string").repartition(3)
    q = spark.createDataFrame([(f"q{k:02d}", x) for k, x in enumerate(texts[:20])], "qid string, lexical string")
    sides = lexical_weights(q, t)
    for side, key, n in zip(sides, ("qid", "tid"), (20, 60)):
        blocks = side.blocks.collect()
        ids = [i for b in blocks for i in from_bytes(bytes(b.data))[key].to_pylist()]
        assert len(ids) == len(set(ids)) == n and sum(len(b.data) for b in blocks) < sum(map(len, texts[:n]))
        assert all(b.n <= 16 and {b.source} == set(from_bytes(bytes(b.data))["source"].to_pylist()) for b in blocks)
    names = spark.createDataFrame([(f"t{k:02d}", 2, x.split()) for k, x in enumerate(texts)], "tid string, source int, tokens array<string>")
    dense = spark.createDataFrame([(f"t{k:02d}", 2, [float(x) for x in v]) for k, v in enumerate(unit(rng, 60))], "tid string, source int, embedding array<float>")
    searches = [sparse_topk(*sides, 3), blocking.token_blocking(names.select(F.col("tid").alias("qid"), "tokens"), names, 3), dense_topk(dense.select(F.col("tid").alias("qid"), "embedding"), dense, 3)]
    for found in searches:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "CoGroup" not in plan
    assert all(r.tid == "t" + r.qid[1:] for r in searches[0].collect() if r.tfidf_rank == 1 and r.source == 2 + int(r.qid[1:]) % 2)
    assert meet(sides[0].blocks, sides[1].blocks, lambda q, t, source: None, R.found_schema(sides[0].key, sides[1].key, "s"), 3, "s").count() == 0


def test_what_leaves_a_meet_follows_the_queries(spark):
    """With many blocks of targets, k rows of a query leave a bounded number of tasks, and the best are among them."""
    from weftlink.operators.blocks import from_bytes, meet, pack
    from weftlink.operators.retrieval import found_schema

    q = spark.createDataFrame([(k, 0) for k in range(32)], "qid long, source int").repartition(8)
    t = spark.createDataFrame([(k, 2) for k in range(480)], "tid long, source int").repartition(48)

    def search(q, t, source):
        ids, met = (from_bytes(x[1])[c].to_numpy() for x, c in ((q, "qid"), (t, "tid")))
        a, b = np.repeat(ids, len(met)), np.tile(met, len(ids))
        return {"qid": pa.array(a), "tid": pa.array(b), "source": pa.array(np.full(len(a), source)), "s": pa.array((a * 31 + b * 17) % 97.0)}

    held = pack(t, "tid", 5)
    assert held.count() >= 96  # blocks
    found = [tuple(r) for r in meet(pack(q, "qid", 4), held, search, found_schema(q, t, "s"), 3, "s").select("qid", "s", "tid").collect()]
    assert len(found) <= 32 * 3 * 4
    for k in range(32):
        want = sorted((-float((k * 31 + b * 17) % 97), b) for b in range(480))[:3]
        assert sorted((-s, b) for a, s, b in found if a == k)[:3] == want


@pytest.mark.parametrize("narrow", [False, True])
def test_few_pairs_are_summed_in_full(monkeypatch, narrow):
    """Bounds leave few pairs of a search to be summed in full, and the k best of each query are exact however wide the matrices are."""
    from weftlink.operators import bounds

    if narrow:  # most grams share columns, and a query meets several tiles
        monkeypatch.setattr(bounds, "EXACT", 20)
        monkeypatch.setattr(bounds, "FOLDED", 30)
        monkeypatch.setattr(bounds, "ROWS", 50)
    rng = np.random.default_rng(3)
    n, summed, plain = (200, 900), [], bounds.row_sums
    monkeypatch.setattr(bounds, "row_sums", lambda *x: summed.append(len(x[3])) or plain(*x))
    dense = []
    for count in n:
        kind = np.arange(count) % 2  # two languages without a common gram but one
        x = (rng.random((count, 400)) < 0.3) * rng.random((count, 400)) * np.where((np.arange(400) < 200) == (kind == 0)[:, None], 1, 0) + np.eye(400)[399] * 0.05
        x[: count // 9] *= rng.random((count // 9, 400)) < 0.05  # short texts, some of them empty
        dense.append(x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9))
    dense[1][50:60] = dense[1][49]  # ties
    entries = lambda x: (*np.nonzero(x), x[np.nonzero(x)], np.arange(400) * 3)
    own, found = bounds.Asked(entries(dense[0]), n[0], 5), []
    for lo in range(0, n[1], 300):
        row, place, score = own.meet(entries(dense[1][lo : lo + 300]), 300)
        found += zip(row.tolist(), (-score).tolist(), (place + lo).tolist())
    scores = np.round(dense[0] @ dense[1].T, 6)
    for i in range(n[0]):
        want = sorted((-s, j) for j, s in enumerate(scores[i].tolist()) if s > 0)[:5]
        assert [j for _, j in want] == [j for r, _, j in sorted(found) if r == i][:5]
    assert sum(summed) < (0.5 if narrow else 0.15) * n[0] * n[1]


def test_dense_bounds_lose_no_pair():
    from weftlink.operators import bounds

    rng = np.random.default_rng(4)
    q, t = unit(rng, 120).astype(float), unit(rng, 700).astype(float)
    t[20:30] = t[19]
    own, found = bounds.Vectors(q, 6), []
    for lo in range(0, 700, 256):
        row, place, score = own.meet(t[lo : lo + 256])
        found += zip(row.tolist(), (-score).tolist(), (place + lo).tolist())
    scores = np.round(q @ t.T, 6)
    for i in range(120):
        assert [j for r, _, j in sorted(found) if r == i][:6] == [j for _, j in sorted((-s, j) for j, s in enumerate(scores[i].tolist()))[:6]]
    assert len(found) < 0.2 * 120 * 700
