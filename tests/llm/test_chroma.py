import numpy as np
import pytest

from weftlink.llm.chroma import FILTERS, GRAY, CUTS, SPAN, align, chroma, codes, excerpt, fingerprint, fingerprint_column, op5_chroma, read_wav, recording, search, write_wav


def melody(seed, n=64):
    return recording(np.random.default_rng(seed).normal(0, 0.1, n).tolist())


def brute_codes(frames):
    out = []
    for t in range(len(frames) - SPAN + 1):
        code = 0
        for kind, y, h, w in FILTERS:
            box = frames[t : t + w, y : y + h].astype(float)
            if kind == 0:
                a, b = box[:, : h // 2].sum(), box[:, h // 2 :].sum()
            elif kind == 1:
                a, b = box[: w // 2].sum(), box[w // 2 :].sum()
            elif kind == 2:
                a = box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum()
                b = box.sum() - a
            else:
                third = h // 3
                a, b = 2 * box[:, third : 2 * third].sum(), box[:, :third].sum() + box[:, 2 * third :].sum()
            level = sum(np.log((a + 0.05) / (b + 0.05)) >= c for c in CUTS)
            code = code << 2 | int(GRAY[level])
        out.append(code)
    return out


def test_codes_equal_plain_sums():
    frames = chroma(melody(1), 4096)
    got, want = codes(frames).tolist(), brute_codes(frames)
    assert len(got) == len(want) and sum((a ^ b).bit_count() for a, b in zip(got, want)) <= 2  # rounding at a cut


def test_pitch_classes():
    t = np.arange(8192) / 4096
    frames = chroma(np.sin(2 * np.pi * 880 * t).astype(np.float32), 4096)
    assert (frames.argmax(axis=1) == 0).all() and np.allclose(np.linalg.norm(frames, axis=1), 1, atol=1e-5)


@pytest.mark.parametrize("first", [0, 3, 20])
def test_alignment(first):
    whole = melody(2)
    a, b = fingerprint(write_wav(excerpt(whole, 256 * first, 5), 4096)), fingerprint(write_wav(whole, 4096))
    offset, error, overlap = align(a, b)
    assert offset == first and error < 0.1 and overlap == len(a)
    assert align(b, a)[0] == -first
    other = align(a, fingerprint(write_wav(melody(3), 4096)))
    assert other[0] is None or other[1] > 0.25


def test_edges():
    silent = write_wav(np.zeros(20_000), 4096)
    for data in (None, b"", b"junk", silent, write_wav(melody(1)[:1000], 4096)):
        assert len(fingerprint(data)) == 0
    assert align(np.zeros(0, np.uint32), fingerprint(silent)) == (None, 1.0, 0)
    same = np.full(5000, 7, np.uint32)
    assert align(same, same) == (0, 0.0, 5000)
    samples, rate = read_wav(write_wav(np.array([0.5, -0.5]), 8000))
    assert rate == 8000 and np.allclose(samples, [0.5, -0.5], atol=1e-3)


def test_frames_and_search(spark):
    rows = [(k, write_wav(melody(k), 4096), "c") for k in range(20)] + [(20, None, None), (None, write_wav(melody(4), 4096), None), (100, write_wav(excerpt(melody(4), 2560, 1), 4096), None)]
    df = spark.createDataFrame(rows, "rec long, audio binary, codes string")
    prints = fingerprint_column(df, id_col="rec")
    assert prints.count() == len(rows)
    found = {(r.query, r.match): r for r in search(prints, prints.where("rec = 100"), id_col="rec").collect()}
    assert found[(100, 4)].offset == 10 and found[(100, 100)].bit_error == 0
    assert {m for _, m in found} <= {4, 100, None}
    held = [7] * 400  # one held tone: a single code for many frames, in many recordings
    tones = spark.createDataFrame([(k, held + [k + 1000, 5, 6, 9, 8]) for k in range(60)], "rec long, codes array<int>")
    same = search(tones, tones.where("rec < 2"), id_col="rec").groupBy("query").count().collect()
    assert {r.query: r["count"] for r in same} == {0: 60, 1: 60}
    with pytest.raises(ValueError):
        fingerprint_column(df.withColumnRenamed("codes", "c").withColumnRenamed("rec", "codes"), id_col="codes")
    assert fingerprint_column(df.limit(0), id_col="rec").count() == 0


def test_query(spark, sf_dir):
    rows = op5_chroma(spark, sf_dir).collect()
    right = [r.offset == r.vec_id % 40 for r in rows]
    assert len(rows) > 10 and np.mean(right) > 0.95 and np.median([r.bit_error for r in rows]) < 0.1
