import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftlink.llm.packing import WordTokenizer, best_fit, pack, vocabulary


def plain_ids(text):
    t = Tokenizer.from_file(vocabulary())
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def held(rows, texts, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in texts.items():
        ids = np.array(plain_ids(text), "<u4")
        got = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // capacity)))
        for r in got:
            part = ids[r.piece * capacity : (r.piece + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(part), zlib.crc32(part.tobytes()))
    assert not by_doc
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in rows)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, tokens = held(pack(docs, vocabulary()).collect(), {r.doc_id: r.text for r in docs.collect()}, 4096)
    assert n <= -(-tokens // 4096) * 1.02 + 1


def test_rounds_and_edges(spark):
    texts = {k: "word " * (k % 37) for k in range(400)} | {1000: None, 1001: "", 1002: " \t\n", 1003: "Ünï cáfe <|endoftext|> it's", 1004: "long " * 500, 1005: "x" * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumnRenamed("zz", "zz").selectExpr("doc_id", "text", "doc_id as piece", "text as load").repartition(8)
    n, tokens = held(pack(df, vocabulary(), capacity=64, bins_per_task=20).collect(), texts, 64)
    assert n <= -(-tokens // 64) * 1.1 + 1
    assert pack(df.limit(0), vocabulary()).count() == 0
    twins = spark.createDataFrame([(None, "a"), (None, "a"), (5, "b"), (5, "b")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in pack(twins, vocabulary()).collect()) == ["5", "5", "None", "None"]


def test_rounds_that_save_nothing_come_to_an_end(spark):
    texts = {k: "word " * (6 if k % 9 else 2) for k in range(600)}  # of 10: two of the larger never meet, the small ones join them
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    n, _ = held(pack(df, vocabulary(), capacity=10, bins_per_task=8).collect(), texts, 10)
    assert n == sum(1 for k in texts if k % 9)
    with pytest.raises(ValueError):
        pack(df, vocabulary(), bins_per_task=1)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    sizes = np.random.default_rng(seed).integers(1, 101, 500)
    bins = best_fit(sizes, 100)
    assert sorted(k for b in bins for k in b) == list(range(500))
    assert all(sizes[b].sum() <= 100 for b in bins)
    assert len(bins) <= 1.25 * sizes.sum() / 100 + 1


def test_words_equal_whole_text():
    texts = ["Straße ÉCOLE x y\x0bz\x1cq", "İstanbul ΟΔΟΣ Ος. don't I'LL", "é ́ a\r\n\r\nb", "日本語 テスト 123 4.5", "", "J\u030cA H\u0331. É, Ö; ÷. x—. €. 3.! a'. it's. ... #a# Ñ&& J. Ǆ.", "THE the The, the. (989) <|endoftext|>.", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|endoftext|> <|endof", "É<|startoftext|>\u0301 x<|endoftext|>"]
    t = WordTokenizer(vocabulary())
    assert plain_ids("x <|endoftext|>")[-2] == 49407
    assert [np.frombuffer(x, "<u4").tolist() + [1] for x in t.encode([x.encode() for x in texts])] == [plain_ids(x) for x in texts]
