"""URL filters (operator 6): host and path rules, then gradient-boosted trees on lexical features.

A rule names a host and a path; it fits that host and all its subdomains where the url's path starts with
the rule's, and the longest rule that fits decides. The other urls go to boosted trees over length, depth, digit
ratio, entropy, parameter counts and suffix statistics, trained from labelled urls: a table of them, or what the
rules and the labels of the shown documents say of the pages at hand (`page_labels`).

Defined results: a null url, or one without `://`, has an empty host and path and goes to the method with
all features zero; of equally long rules the first in order wins; urls are judged one by one, so repeated rows agree; an
empty table gives no rows; without labelled urls of both kinds everything left by the rules is allowed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import table

#: The rules of the query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def _until(text: str, stops: str) -> str:
    return text[: min((k for k in map(text.find, stops) if k >= 0), default=len(text))]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = _until(rest, "/?#")
    return host.translate(_ASCII_LOWER), _until(rest[len(host) :], "?#")


class RuleSet:
    """Rules by host; a lookup costs one step for each label of the url's host."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list] = defaultdict(list)
        for verdict, host, path in rules:
            self.by_host[host].append((host + path, path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while host and at >= 0:
            for name, start, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best[0] is None or len(name) > len(best[0])):
                    best = (name, verdict)
            at = host.find(".", at) + 1 or -1
        return best


FEATURES = ("length", "host_length", "host_labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "suffix_1", "suffix_2")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * np.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


@dataclass
class UrlModel:
    """Boosted regression trees in heap order and smoothed log-odds of host suffixes."""

    suffixes: dict[str, float] = field(default_factory=dict)
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    base: float = -20.0

    def features(self, url: str | None) -> list[float]:
        if not url or "://" not in url:
            return [0.0] * len(FEATURES)
        host, path = split_url(url)
        query = url.partition("?")[2].partition("#")[0]
        digits = lambda s: sum(map(str.isdigit, s)) / max(len(s), 1)
        one, two = _suffixes(host)
        return [len(url), len(host), host.count(".") + 1, sum(1 for p in path.split("/") if p), digits(url), digits(host), host.count("-"), _entropy(url), _entropy(host),
                sum(1 for p in query.split("&") if p), len(query), self.suffixes.get(one, 0.0), self.suffixes.get(two, 0.0)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while (inner := f[node] >= 0).any():
                at = node[inner]
                node[inner] = 2 * at + 1 + (x[rows[inner], f[at]] > c[at])
            total += v[node]
        return total


def train(urls: list[str], blocked: np.ndarray, *, rounds: int = 80, depth: int = 3, rate: float = 0.2, least: int = 5, smoothing: float = 5.0) -> UrlModel:
    """Logistic boosting with Newton leaves; `blocked` marks the urls to block."""
    if not len(urls) or blocked.all() or not blocked.any():
        return UrlModel()
    share = blocked.mean()
    seen: dict[str, list] = defaultdict(lambda: [0, 0])
    for url, bad in zip(urls, blocked):
        for s in set(_suffixes(split_url(url)[0])):
            seen[s][0] += bad
            seen[s][1] += 1
    prior = np.log(share / (1 - share))
    model = UrlModel({s: float(np.log((b + smoothing * share) / (n - b + smoothing * (1 - share))) - prior) for s, (b, n) in seen.items()}, base=float(prior))
    x = np.array([model.features(u) for u in urls])
    y = blocked.astype(float)
    nodes = 2 ** (depth + 1) - 1
    logit = np.full(len(x), prior)
    trees = []
    order = np.argsort(x, axis=0, kind="stable")
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p) + 1e-6
        f, c, v = np.full(nodes, -1, np.int16), np.zeros(nodes), np.zeros(nodes)
        todo = [(0, np.ones(len(x), bool))]
        while todo:
            node, inside = todo.pop()
            v[node] = rate * g[inside].sum() / (h[inside].sum() + 1.0)
            if 2 * node + 2 >= nodes or inside.sum() < 2 * least:
                continue
            whole = g[inside].sum() ** 2 / (h[inside].sum() + 1.0)
            best = (1e-6, -1, 0.0)
            for k in range(x.shape[1]):
                rows = order[inside[order[:, k]], k]
                values = x[rows, k]
                gl, hl = np.cumsum(g[rows])[:-1], np.cumsum(h[rows])[:-1]
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - whole
                size = np.arange(1, len(rows))
                gain[(values[1:] <= values[:-1]) | (size < least) | (size > len(rows) - least)] = -1
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], k, (values[at] + values[at + 1]) / 2)
            if best[1] >= 0:
                f[node], c[node] = best[1], best[2]
                right = inside & (x[:, best[1]] > best[2])
                todo += [(2 * node + 1, inside & ~right), (2 * node + 2, right)]
        trees.append((f, c, v))
        model.feature, model.cut, model.value = (np.stack(a) for a in zip(*trees[-1:]))
        logit += model.logit(x) - prior
    model.feature, model.cut, model.value = (np.stack(a) for a in zip(*trees))
    return model


def page_labels(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", doc_col: str = "doc_id") -> DataFrame:
    """(url, blocked) of the pages that something labels: a rule, by its verdict, or else the labels of the document they show.

    The last number of a page's path names that document; a page of one labelled of low quality or toxic is to be blocked,
    of one labelled good and clean allowed.
    """
    ruled = judge(pages, UrlModel(), rules, id_col=id_col, url_col=url_col).where("rule is not null").select(F.col(id_col).alias("_page"), (F.col("verdict") == "block").alias("_rule"))
    urls = pages.select(F.col(id_col).alias("_page"), F.col(url_col).cast("string").alias("url")).where("url is not null")
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    number = F.regexp_extract(path, r"(\d{1,18})\D*$", 1)
    shown = urls.withColumn("_doc", F.when(number != "", number.cast("long")))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(doc_col).cast("long").alias("_doc")).agg(F.max(bad.cast("int")).alias("_bad"))
    both = shown.join(ruled.distinct(), "_page", "left").join(known, "_doc", "left")
    return both.select("url", F.coalesce("_rule", F.col("_bad") == 1).alias("blocked")).where("blocked is not null")


def labelled_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most: int = 20_000) -> tuple[list[str], np.ndarray]:
    """At most `most` labelled urls, by their hash, as training input."""
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).orderBy(F.xxhash64(url_col), url_col, label_col).limit(most).select(url_col, F.col(label_col).cast("boolean")).collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], bool)


_JUDGED = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")] + [T.StructField("score", T.DoubleType())]


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict and score (null where a rule decides) of every url."""
    source = pages.select(pages[id_col], pages[url_col].cast("string").alias("_url"))
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), *_JUDGED])
    shared = pages.sparkSession.sparkContext.broadcast((model, rules))

    def run(batches):
        model, found = shared.value[0], RuleSet(shared.value[1])
        arrow = to_arrow_schema(schema)
        for batch in batches:
            urls = batch.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            hits = [found.find(h, p) for h, p in parts]
            open_ = [k for k, hit in enumerate(hits) if hit[1] is None]
            score: list[float | None] = [None] * len(urls)
            verdict = [hit[1] for hit in hits]
            if open_:
                logit = model.logit(np.array([model.features(urls[k]) for k in open_]))
                for k, p in zip(open_, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))):
                    score[k], verdict[k] = float(p), "block" if p >= cut else "allow"
            columns = [[h for h, _ in parts], [p for _, p in parts], [hit[0] for hit in hits], verdict, score]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return source.mapInArrow(run, schema)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url. The trees learn from the urls of `pages` that a rule or a labelled document labels."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return judge(pages, train(*labelled_urls(page_labels(pages, labels))))


RULES_SQL = r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '', '') AS h, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
 r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(verdict, rh, rp)),
 f AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS i FROM v JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT v.page_id, host, path, f.rule, f.verdict AS rule_verdict FROM v LEFT JOIN f ON f.page_id = v.page_id AND f.i = 1
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of `op6_url_filter` that SQL can state: host, path, rule and the rule's own verdict."""
    verdict = F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict")
    return judge(table(spark, sf_dir, "pages"), UrlModel()).select("page_id", "host", "path", "rule", verdict)
