import html
import random
import re
import zlib

import pytest

from weftlink.llm.html_wrapper import Page, Wrapper, _anchored, _common, _fold, _longest, extract, infer_wrappers, main_text, op10_html_extraction


def plain_article(source):
    """The generated pages' articles hold only h1, p, b and br elements."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    inner = re.sub(r"</?b>", "", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_driver_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: (r.url, plain_article(r.html)) for r in df.collect()}
    rows = extract(df, infer_wrappers(df)).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def site(k, article=True, words=40):
    body = f"<h1>Title {k}</h1>" + "".join(f"<p>Text {k} part {j} " + f"word{k}x{j} " * words + "</p>" for j in range(1 + k % 4))
    holder = ("<article>", "</article>") if article else ("<div class='c1'>", "</div>")
    return (
        f"<html><head><title>T {k}</title><style>p{{}}</style><script>if (a < b) x='</p>';</script></head><body class='has-sidebar'>"
        f"<header><a href='/'>Site</a></header><nav><ul>" + "".join(f"<li><a href='/{j}'>Menu {j}</a></li>" for j in range(3 + k % 3)) + "</ul></nav>"
        + ("<div class='cookie-notice'>We use cookies</div>" if k % 2 else "") + f"<div id='top-ad'>Buy {k}</div>" + holder[0] + body
        + "<p>Share this text with all your friends</p>" * (not article) + holder[1]
        + f"<section id='comments'><div class='comment'><p>Reader {k} says no</p></div></section><aside>More {k}</aside><form><p>Name</p></form><footer>&copy; {k}</footer></body></html>"
    )


def wanted(k, words=40):
    return " ".join((f"Title {k} " + " ".join(f"Text {k} part {j} " + f"word{k}x{j} " * words for j in range(1 + k % 4))).split())


@pytest.mark.parametrize("article", [True, False])
def test_boilerplate_goes(spark, article):
    df = spark.createDataFrame([(k, f"https://Host.example/{k}", site(k, article)) for k in range(40)], "page_id long, url string, html string").repartition(5)
    wrappers = infer_wrappers(df)
    assert [r.host for r in wrappers.collect()] == ["host.example"]
    got = {r.page_id: r.text for r in extract(df, wrappers).collect()}
    assert got == {k: wanted(k) for k in range(40)}


def test_wrapper_is_an_expression():
    w = Wrapper()
    for source in ("<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul><i></i><p>y</p>", "<ul><li>c</li><li>d</li><li>e</li></ul>"):
        w.add(Page(source).outline()[0], set())
    assert w.expression() == "<ul>(<li>#</li>)+</ul>(#)?"
    assert w.slots[w.locate(Page("<ul><li>z</li></ul>").symbols, False)[2]]["<li>"][0] == 3
    assert _fold(list("#") * 5, set())[0] == ["(#)+"]
    assert Wrapper.load(w.dump()).dump() == w.dump()


def bare_site(k):
    """No article element, no telling class, id or role; menu, tag line, teaser, notice and footer all in plain boxes."""
    teasers = "".join(f"<li><a href='/{j}'>Teaser {j} of the day {k * 7 + j}</a></li>" for j in range(4 + k % 3))
    return (
        f"<html><body><div class='x'><b>Our site</b><p>A tag line that stands on every page</p></div><div class='m'><ul>" + "".join(f"<li><a href='/{j}'>Menu {j}</a></li>" for j in range(5)) + "</ul></div>"
        + f"<div class='c'><h1>Title {k}</h1><div class='n'>We use small files to count visits</div>" + "".join(f"<p>Text {k} part {j} " + f"word{k}x{j} " * 30 + "</p>" for j in range(1 + k % 4))
        + f"<p>Share this text with all your friends</p></div><div class='s'><p>Elsewhere</p><ul>{teasers}</ul><p>Weather today {k}</p></div><div class='f'>All rights reserved</div></body></html>"
    )


def test_slots_alone_decide(spark):
    df = spark.createDataFrame([(k, f"http://h/{k}", bare_site(k)) for k in range(40)], "page_id long, url string, html string")
    want = {k: wanted(k, 30) for k in range(40)}
    found = []
    for rows, size in ((df.coalesce(1).orderBy("page_id"), 256), (df.orderBy("page_id", ascending=False).repartition(7), 256), (df.repartition(3), 8)):
        wrappers = infer_wrappers(rows, bucket_pages=size)
        found.append({r.page_id: r.text for r in extract(df, wrappers).collect()})
        if size == 256:
            found.append(wrappers.first().wrapper)
    assert found[0] == found[2] == found[4] == want and found[1] == found[3]
    assert all(main_text(bare_site(k), Wrapper()) != want[k] for k in range(40))


def test_slots_decide_inside_articles(spark):
    page = lambda k: f"<body><article><h1>Title {k}</h1><p>Own words {k}</p><div class='z'>Read this tomorrow too</div><ul>" + "".join(f"<li><a href='/{k}{j}'>Story {k * 9 + j}</a></li>" for j in range(5)) + "</ul></article></body>"
    df = spark.createDataFrame([(k, "http://h/", page(k)) for k in range(20)], "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in extract(df, infer_wrappers(df)).collect()} == {k: f"Title {k} Own words {k}" for k in range(20)}
    assert main_text(page(1), Wrapper()) != "Title 1 Own words 1"


def test_near_copies_and_common_lines_stay(spark):
    """A third of a host's pages are near copies, half hold one line; both belong to the articles."""
    line = "<p>A line that half of the articles hold</p>"
    page = lambda k: f"<body><nav><a href='/'>Home</a></nav><article><h1>Title {k}</h1>{line * (k % 2)}<p>{'Much copied words' if k % 3 == 0 else f'own {k}'}</p><p>end {k}</p></article></body>"
    df = spark.createDataFrame([(k, "http://h/", page(k)) for k in range(60)], "page_id long, url string, html string").repartition(3)
    want = {k: " ".join(f"Title {k} {'A line that half of the articles hold' * (k % 2)} {'Much copied words' if k % 3 == 0 else f'own {k}'} end {k}".split()) for k in range(60)}
    assert {r.page_id: r.text for r in extract(df, infer_wrappers(df)).collect()} == want


def test_wide_wrappers_keep_every_structure(spark):
    """Forty layouts on one host, and one page of a thousand unlike blocks."""
    tags = ["section", "div", "figure", "details", "address", "fieldset", "menuitem"]
    layout = lambda k: "".join(f"<{tags[(k >> j) % 7]} class='{'abcdefgh'[(k * 3 + j) % 8]}'>" for j in range(6))
    page = lambda k: f"<body><div class='top'>Same on all</div>{layout(k % 40)}<p>Own words {k}</p></body>"
    wide = "<body><div class='top'>Same on all</div>" + "".join(f"<section class='{'abcdefgh'[j % 8]}{'ijklmnop'[j // 8 % 8]}{'qrstuvwx'[j // 64 % 8]}'><p>Block {j}</p></section>" for j in range(1000)) + "</body>"
    df = spark.createDataFrame([(k, "http://h/", page(k)) for k in range(200)] + [(999, "http://h/", wide)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extract(df, infer_wrappers(df, bucket_pages=32)).collect()}
    assert got == {k: f"Own words {k}" for k in range(200)} | {999: " ".join(f"Block {j}" for j in range(1000))}


@pytest.mark.parametrize("seed", range(4))
def test_alignments_are_common_subsequences(seed):
    rng = random.Random(seed)
    x = [rng.choice("abcdef") + str(rng.randrange(3)) for _ in range(300)]
    y = [c for c in x if rng.random() < 0.8] + ["z"]
    full, far = _longest(x, y), _anchored(x, y)
    for pairs in (full, far, _common(x, y)):
        assert all(x[i] == y[j] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    assert len(full) == len(y) - 1
    unlike = [f"u{k}" for k in range(3000)]
    assert _anchored(unlike, unlike[::2]) == [(2 * k, k) for k in range(1500)]


@pytest.mark.parametrize("source,text", [
    (None, ""), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("a<b>b</b>c <i> d</i>", "abc d"), ("<p>one<p>two<br>three", "one two three"),
    ("<p>x &amp; y&nbsp;&#233;</p><!-- <p>no</p> --><p>z", "x & y é z"), ("<p>a < b and c > d</p>", "a < b and c > d"), ("<p>end</p><div class=\"x", "end"),
    ("<p title='a > b'>q</p>", "q"), ("<article><header><h1>H</h1></header><p>t</p><footer>f</footer></article><p>out</p>", "H t"),
    ("<nav>menu<article><p>t</p></article>", "t"), ("<main><article>a</article><div class='related-posts'>r</div><article>b</article></main>", "a b"),
    ("<div role='navigation'>n</div><p hidden>h</p><p style='display: none'>s</p><p>v</p>", "v"), ("<!-- open <p>x", ""), ("<script>x", ""), ("<table><tr><td>1</td><td>2</td></tr></table>", "1 2"),
    ("<article><p>t</p><section class=\"comments\"><article class=\"comment\">c</article></section></article>", "t"), ("<p>" * 5000 + "deep", "deep"), ("w" * 300_000, "w" * 300_000),
])
def test_single_pages(source, text):
    assert main_text(source, Wrapper()) == text


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "<p>a</p>", 1), (2, "no host", None, 2), (None, "http://h/", "<p>c</p>", 3), (4, "http://h/", "<p>d</p>", 4), (4, "http://h/", "<p>d</p>", 4)], "page_id long, url string, html string, text int")
    rows = sorted(extract(df, infer_wrappers(df)).collect(), key=str)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "c", 1), (1, "a", 1), (2, "", 0), (4, "d", 1), (4, "d", 1)]
    none = df.limit(0)
    assert extract(none, infer_wrappers(none)).count() == 0


def test_copies_are_no_evidence(spark):
    df = spark.createDataFrame([(k, "http://h/x", "<div><p>same words</p></div>") for k in range(20)], "page_id long, url string, html string").repartition(4)
    assert {r.text for r in extract(df, infer_wrappers(df)).collect()} == {"same words"}


def test_copies_beside_many_pages_are_no_evidence(spark):
    own = max((f"own words {k}" for k in range(200)), key=lambda t: zlib.crc32(f"lead\x00{t}".encode()))
    copies = [f"<div><p>lead</p><blockquote>{own}</blockquote></div>"] * 60
    pages = [f"<div><p>text of page {k}</p></div>" for k in range(60)] + copies
    df = spark.createDataFrame([(k, "http://h/x", p) for k, p in enumerate(pages)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in extract(df, infer_wrappers(df)).collect()}
    assert {got[60 + k] for k in range(60)} == {f"lead {own}"}
    assert all(got[k] == f"text of page {k}" for k in range(60))


def test_query(spark, sf_dir):
    assert op10_html_extraction(spark, sf_dir).columns == ["page_id", "url", "text", "n_chars"]
