import corpus_pipeline
from test_packing import held
from test_shingle_join import brute_groups
from test_substring_dedup import brute

from weftlink.llm import quality_forest, toxicity


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.schema, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept[name] = rows(docs), None
        found = stage(spark, docs, sf_dir)
        if name == "quality_rules":
            verdict = {r.doc_id: r.kept for r in quality_forest.judge(docs, quality_forest.fit(docs, labels)).collect()}
            want = {i: r for i, r in before.items() if verdict[i]}
        elif name == "toxicity":
            verdict = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels, learn=toxicity.fold() != 0)).collect()}
            want = {i: r for i, r in before.items() if not verdict[i]}
        elif name == "simhash_near_dedup":
            label = brute_groups({i: r.text for i, r in sorted(before.items())})
            want = {i: r for i, r in before.items() if label[i] == i}
            assert len(want) < len(before)
        elif name == "substring_dedup":
            removed = {i: n for i, _, n, _ in brute([(i, r.text) for i, r in before.items()])}
            full = {i: n for i, n, _, _ in brute([(i, r.text) for i, r in before.items()])}
            got = rows(found)
            assert {i for i in got} == {i for i in before if full[i] == 0 or removed[i] < full[i]}
            for i, r in got.items():
                assert len(r.text.split()) == full[i] - removed[i] and r.n_chars == len(r.text)
                assert removed[i] or r == before[i]
            want = got
        else:
            held(found.collect(), {i: r.text for i, r in before.items()}, 4096)
            return
        assert found.schema == columns
        found.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert rows(docs) == want


def test_run_and_empty(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0


def test_edge_rows_and_clashing_names(spark, sf_dir):
    """Nulls in every column, blank and very long texts, repeated rows and ids, and columns named like the operators' own."""
    clash = ["_drop", "_edit_id", "_edit_row", "_edit_text", "_bits", "_set", "_first", "score", "kept", "_id", "_row", "spans", "pieces", "load", "n_words"]
    base = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text and len(r.text.split()) > 60][:40]
    long_text = " ".join(f"w{k} x{k % 97}" for k in range(30_000))
    texts = [(r.doc_id, r.text) for r in base] + [(None, base[0].text), (None, base[0].text), (9001, None), (9002, ""), (9003, " \n\t"), (9004, long_text), (9005, long_text), (base[1].doc_id, base[1].text), (base[2].doc_id, base[3].text)]
    made = [(i, t, None, None, None, *["c"] * len(clash)) for i, t in texts]
    docs = spark.createDataFrame(made, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{c} string" for c in clash)])).repartition(4)
    count = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).collect()
        count[name] = len(out)
        if name != "best_fit_packing":
            assert stage(spark, docs, sf_dir).schema == docs.schema and all(r[c] == "c" for r in out for c in clash)
        else:
            assert {r.doc_id for r in out} == {i for i, _ in texts}
    assert count["quality_rules"] <= len(texts) - 3 and count["toxicity"] <= len(texts) and count["simhash_near_dedup"] < len(texts) and count["substring_dedup"] < len(texts)
