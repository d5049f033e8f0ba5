import itertools

import pytest
import sentencepiece
import xxhash

from weftlink.llm.merge_dropout import BLANK, MergeModel, decode, digest, encode, op7_sentencepiece, vocabulary

TEXTS = ["", " ", "  two  blanks ", "a\tb\nc\r\n", "Ünïcode ñ 日本 🙂 é́", "▁literal ▁▁ mark▁", "x" * 3000, "the quick brown fox jumps over the lazy dog " * 20, "\x00\x01", "…—–“”", "\ue000\uf8ff", " ▁ "]


@pytest.fixture(scope="module")
def model():
    return MergeModel.of(vocabulary())


def test_without_dropout_equals_the_library(model, spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    turns = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    for text in turns + [t for t in TEXTS if BLANK not in t]:
        assert model.encode(text) == sp.encode(text)


def brute(model, text, dropout, seed, key):
    """Agenda by rescanning all neighbours; a candidate is judged once for each time its pair arises."""
    base = xxhash.xxh64_intdigest(f"{seed}\x1f{key}".encode())
    symbols = [(k, c) for k, c in enumerate(BLANK + text.replace(" ", BLANK))]
    gone = set()
    while True:
        found = []
        for (i, a), (j, b) in itertools.pairwise(symbols):
            hit = model.rank.get(a + b)
            if hit and (i, a, j, b) not in gone:
                found.append((hit[0], i, a, j, b, hit[1]))
        if not found:
            return [k for _, s in symbols for k in model._single(s)]
        _, i, a, j, b, piece = min(found)
        if xxhash.xxh64_intdigest((i << 32 | piece).to_bytes(16, "little"), base) < int(dropout * (1 << 64)):
            gone.add((i, a, j, b))
            continue
        at = symbols.index((i, a))
        symbols[at : at + 2] = [(i, a + b)]


def test_dropout_equals_brute_force(model):
    for seed, text in itertools.product(range(4), ["hello world again", "Überraschung  am Abend", "aaaaaaaabbbb", "the cat sat on the mat, thinking."]):
        assert model.encode(text, 0.3, seed, "k") == brute(model, text, 0.3, seed, "k")


def test_lossless_varied_and_stable(model):
    for text in TEXTS:
        for seed in range(5):
            ids = model.encode(text, 0.4, seed, "row")
            assert model.decode(ids) == text
            assert ids == model.encode(text, 0.4, seed, "row")
    long = "the quick brown fox jumps over the lazy dog " * 5
    assert len({tuple(model.encode(long, 0.2, s, "row")) for s in range(8)}) == 8
    assert len(model.encode(long, 0.9, 0, "")) > len(model.encode(long, 0.1, 0, "")) > len(model.encode(long))


def test_frames(spark, sf_dir):
    df = spark.createDataFrame([(1, None, t, "x") for t in TEXTS] + [(None, 2, None, None), (3, 3, "same", "y"), (3, 3, "same", "z")], "conv_id long, turn long, text string, ids string")
    coded = decode(encode(df, vocabulary(), key_cols=["conv_id", "turn"], dropout=0.3), vocabulary())
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + 3 and all(r.decoded == (r.text or "") for r in rows)
    assert len({tuple(r.ids) for r in rows if r.text == "same"}) == 1
    assert all(r.lossless for r in digest(coded).collect())
    assert encode(df.limit(0), vocabulary(), key_cols=["conv_id"]).count() == 0
    got = op7_sentencepiece(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").count() and got.where("not lossless").count() == 0
