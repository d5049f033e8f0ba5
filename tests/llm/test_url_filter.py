import random

import numpy as np
import pytest

from weftlink.llm.url_filter import RULES, UrlModel, judge, labelled_urls, op6_url_filter, page_labels, split_url, train


def listed(n=3000, seed=0):
    """Urls labelled by how they were made: link farms with hyphens, numbers, deep random paths and parameters, or plain articles."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    token = lambda: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 20)))
    urls, blocked = [], []
    for k in range(n):
        bad = k % 3 == 0
        if bad:
            url = f"http://{word()}-{word()}{rng.randrange(1000)}.com/" + "/".join(token() for _ in range(rng.randint(1, 5))) + "?" + "&".join(f"{word()}={token()}" for _ in range(rng.randint(0, 5)))
        else:
            url = f"http://{rng.choice(['www.', 'blog.', ''])}{word()}.{rng.choice(['org', 'com'])}/" + "/".join(word() for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", ".html", "?page=2"])
        urls.append(url)
        blocked.append(bad)
    return urls, np.array(blocked)


@pytest.fixture(scope="module")
def model():
    return train(*listed())


@pytest.mark.parametrize("url,host,path", [
    ("http://A.Example.NET/en/5?x=/y#z", "a.example.net", "/en/5"), ("HTTPS://h", "h", ""), ("h/x", "", ""), (None, "", ""), ("", "", ""), ("://?q", "", ""),
    ("x://h#f/g?", "h", ""), ("http://É.com/É", "É.com", "/É"), ("a://b://c", "b:", "//c"),
])
def test_split(url, host, path):
    assert split_url(url) == (host, path)


def brute_rule(host, path):
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_rules_and_edges(spark, model):
    urls = ["http://net/", "http://x.net/de", "http://example.net/en/1", "http://a.example.net/en", "http://b.example.com/de/", "http://bexample.com/de/", "http://q.org/fr/x", "http://org", "http://x.net", None, "", "nothing", "http://x.com/", "http://x.com/", "http://.net/", "http://net./"]
    df = spark.createDataFrame([(k, u, "c") for k, u in enumerate(urls)] + [(None, "http://x.net/", None)], "page_id long, url string, rule string")
    rows = judge(df, model).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        url = "http://x.net/" if r.page_id is None else urls[r.page_id]
        rule, verdict = brute_rule(*split_url(url))
        assert r.rule == rule and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)
    assert judge(df.limit(0), model).count() == 0


def test_held_out_accuracy(model):
    urls, blocked = listed(2000, seed=99)
    logit = model.logit(np.array([model.features(u) for u in urls]))
    assert ((logit > 0) == blocked).mean() > 0.95


def test_labels_from_the_tables(spark):
    pages = [(1, "http://a.net/en/5"), (2, "http://x.org/fr/6"), (3, "http://x.org/en/7?page=9#4"), (4, "http://x.org/en/8.html"), (5, "http://x.org/en/9/"), (6, "http://x.org/en/no"), (7, None), (8, "http://x.org/en/10"), (8, "http://x.org/en/10")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, blocked int")
    labels = spark.createDataFrame([(6, 0, 0), (7, 0, 0), (8, 1, 1), (9, 1, 0), (10, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.url: r.blocked for r in page_labels(df, labels).collect()}
    assert got == {"http://a.net/en/5": True, "http://x.org/fr/6": False, "http://x.org/en/7?page=9#4": True, "http://x.org/en/8.html": True, "http://x.org/en/9/": False}
    assert page_labels(df.limit(0), labels).count() == 0


def test_without_labels(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    assert train(*labelled_urls(none)).logit(np.zeros((1, 13)))[0] < 0
    assert isinstance(train(["http://a"], np.array([True])), UrlModel)


def test_query(spark, sf_dir):
    rows = op6_url_filter(spark, sf_dir).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages) and {r.verdict for r in rows} <= {"allow", "block"}
    for r in rows:
        assert (r.host, r.path) == split_url(pages[r.page_id]) and r.rule == brute_rule(r.host, r.path)[0]
