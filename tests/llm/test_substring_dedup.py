import hashlib
import random

import pyarrow as pa
import pytest

from weftlink.llm.substring_dedup import WINDOW, FingerprintIndex, digest, extend, strip_repeats, window_anchors
from weftlink.llm.textkernel import slices


def brute(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        if i is not None:
            for k in range(len(words) - WINDOW + 1):
                key = tuple(words[k : k + WINDOW])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        if i is not None:
            for k in range(len(words) - WINDOW + 1):
                if first[tuple(words[k : k + WINDOW])] < i:
                    gone.update(range(k, k + WINDOW))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(500)
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 76, 120, 300)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 10)
            words += p[a:] if rng.random() < 0.5 else p
            words += [word() for _ in range(rng.randrange(0, 30))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, "same again " * 90), (503, "same again " * 90), (504, None), (505, ""), (506, " \n ")]
    rows += [(507, rows[7][1]), (507, rows[7][1]), (508, "a " * 400), (509, "a " * 500), (None, rows[5][1]), (None, rows[5][1]), (510, rows[9][1] + " " + rows[12][1]), (510, rows[20][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batches,fan_in", [(0, 1, 4), (1, 3, 1), (2, 2, 4)])
def test_equals_brute_force(spark, seed, batches, fan_in):
    rows = planted(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in digest(df, batches=batches, fan_in=fan_in).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_driver_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in digest(df).collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_anchors_follow_content():
    words = [f"w{k}" for k in range(400)]
    found = []
    for shift in (0, 7):
        part = next(slices(pa.array([" ".join(["x"] * shift + words)])))
        at, anchor = window_anchors(part)
        found.append({int(a) - shift: h for a, h in zip(at, anchor) if a >= shift})
    assert found[0] == found[1]
    assert 10 < len(set(found[0].values())) < 100


def test_strip_and_empty(spark):
    text = " ".join(f"t{k}" for k in range(70))
    df = spark.createDataFrame([(1, text, 5), (2, "start\n " + text + " end", 6), (3, text, 7), (4, " short  text ", 8)], "doc_id long, text string, n_chars long")
    kept = strip_repeats(df)
    assert kept.schema == df.schema
    assert sorted(tuple(r) for r in kept.collect()) == [(1, text, 5), (2, "start\n end", 10), (4, " short  text ", 8)]
    assert strip_repeats(df.limit(0)).count() == 0
    assert digest(df.limit(0)).count() == 0


def test_two_jobs_over_one_stored_index(spark, tmp_path):
    """A first job stores its index; a second opens it, adds later documents, and compacts."""
    rows = [r for r in planted(5) if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = FingerprintIndex(df, folder=str(tmp_path / "index"), buckets=3)
    got = [extend(first, None, 60), extend(first, 60, 100)]
    first.save()
    first.close(keep=True)
    later = FingerprintIndex.open(df, str(tmp_path / "index"))
    assert later.buckets == 3 and len(later.anchors.runs) == 2
    with pytest.raises(ValueError, match="up to 100"):
        later.add(50, 200)
    got += [extend(later, 100, 400), extend(later, 400, None)]
    assert later.compactions >= 2 and later.highest == 510
    plan = later.anchors.look_up(spark.range(5).withColumnRenamed("id", "h").groupBy("h").count())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == len(later.anchors.runs)
    found = {}
    for survey, edits in got:
        lost = {(r._id, r._row): (r.n_removed, r.kept_sha) for r in edits.collect()}
        for r in survey.collect():
            found.setdefault(r._id, []).append((r._id, r.n_words, *lost.get((r._id, r._row), (0, r.sha))))
    assert sorted((x for v in found.values() for x in v), key=str) == brute(rows)
    later.close()


def test_runs_are_read_in_place(spark):
    """A join with a run neither exchanges nor sorts the run, and compaction gives what a plain aggregate gives."""
    from weftlink.llm.substring_dedup import Runs, _sorted_scans
    from weftlink.session import scratch

    runs = Runs(spark, scratch(spark, "t"), "anchors", {"h": "bigint"}, 4, 2)
    with _sorted_scans(spark):
        for lo in (0, 500):
            made = spark.range(lo, lo + 1000).selectExpr("id as h", "id * 2 as first", "id % 7 = 0 as shared", "cast(null as long) as old")
            runs.append(made.groupBy("h", "first", "shared", "old").count())
        asked = spark.range(0, 3000, 3).withColumnRenamed("id", "h").groupBy("h").count()
        plan = runs.look_up(asked)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2
        want = {(k, k * 2, 500 <= k < 1000 or k % 7 == 0) for k in range(1500)}
        runs.compact()
    assert len(runs.runs) == 1
    assert {(r.h, r.first, r.shared) for r in spark.table(list(runs.runs.values())[0]).collect()} == want
