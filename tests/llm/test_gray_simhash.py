import itertools

import numpy as np
import pytest
import xxhash

from weftlink.llm.gray_simhash import GrayIndex, fingerprints, near_duplicate_components, one_of_each


def brute_fingerprint(text):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows, most=2):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    label = {i: i for i in prints}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= most]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return prints, label


@pytest.mark.parametrize("most", [0, 1, 2])
def test_index_finds_all_pairs(most):
    rng = np.random.default_rng(most)
    codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = codes[:100].copy()
    for k in range(100):
        for bit in rng.choice(64, k % 4, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    codes = np.unique(np.concatenate((codes, near)))
    found = {(int(a), int(b)) for q, c in GrayIndex(codes).within(codes, most, block=37) for a, b in zip(q, c)}
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert found == set(zip(*(x.tolist() for x in np.nonzero(apart <= most))))


@pytest.mark.parametrize("hot_rows", [4096, 1])
def test_components_equal_brute_force(spark, sf_dir, hot_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows += [(900 + k, base + f" {k}") for k in range(6)] + [(950, None), (951, ""), (952, " \n"), (953, "A b"), (954, "a B"), (955, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component_id string").drop("component_id")
    prints, label = brute_components(rows)
    got = near_duplicate_components(fingerprints(df), hot_rows=hot_rows).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r._bits & (1 << 64) - 1 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == label


def test_one_of_each_and_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", "p"), (2, "a b c d", "q"), (2, "a b c d", "q"), (None, "a b c d", "r"), (4, "other words are here", None)], "doc_id long, text string, _bits string")
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4]
    assert one_of_each(df.limit(0)).count() == 0
