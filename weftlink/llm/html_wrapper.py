"""HTML extraction (operator 10) by union-free regular-expression inference.

The token streams of a host's pages are aligned one after the other into a wrapper: a sequence of tags,
text slots, optional parts and repeated groups. Tokens are the block tags, each with its first class, and `#` for a run
of text with its paragraphs and inline tags. Tandem repeats of a stream fold into groups, known groups also
fold single occurrences, a mismatch that the longest common subsequence leaves on either side becomes optional, and texts
that meet in one place, after one and the same tag, are a slot.

What a slot gathers decides about its texts. A text is *frequent* if it is on 3 and on 5 % of the host's pages (counted
exactly, over all tasks). In a slot that holds mostly frequent texts those are template, and so is a text that
half of the slot's pages share (0.85 of them inside an article or main element, whose texts may be near copies). A
slot of mostly linked blocks is a menu; inside an article that takes a repeated group. The main region is the innermost
element, by tags and classes, that keeps nine tenths of the host's own texts and leaves behind no headline and more
template than own text; what lies outside goes. Tags, classes and roles break the ties that remain: own
texts inside the region that a reader comment, form, advert or the like holds, or that stand beside an article element. They decide alone
only where a host has fewer than `EVIDENCE` distinct pages or a page's text meets no slot.

Inference does not depend on the order or the layout of rows. Pages of a host with equal texts count once over all tasks; the
distinct ones are dealt to buckets of about `BUCKET_PAGES` by digest, aligned there in order of digest, and the
buckets' wrappers merge in order, `FAN_IN` at a time. A wrapper grows with the distinct structure of its host.

Defined results: null and empty pages give an empty text; unclosed tags and comments end with the page;
rows that repeat a page give the same text each; a null or hostless url is read with the wrapper of the empty host; an
empty table gives no rows. Whole pages are read.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import json
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, drop_path, scratch, table
from .frames import small_batches

EVIDENCE = 6  # distinct pages
FREQUENT_PAGES, FREQUENT_PERCENT = 3, 5
TEMPLATE_SLOT = 0.8
TEMPLATE_TEXT, TEMPLATE_TEXT_MAIN = 0.5, 0.85
REGION_SHARE = 0.9
BUCKET_PAGES = 256
FAN_IN = 16
LONGEST_GROUP = 40
ALIGNED_CELLS = 1 << 20
BROADCAST_BYTES = 16 << 20

# Names of elements and words of class, id and role attributes.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
APART = {"nav", "footer", "aside", "form", "noscript", "template", "object", "svg", "math", "canvas", "audio", "video", "head", "button", "select", "dialog", "menu", "datalist"} | RAW
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "img"}
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "footer", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "signup", "login", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "breadcrumb", "breadcrumbs", "pagination", "pager", "copyright", "menu", "navbar", "navigation", "nav", "skip", "masthead", "topbar", "toolbar"}
WEAK = {"sidebar", "side", "aside", "header", "widget", "widgets", "banner", "notice", "notices", "alert", "notification", "search", "disclaimer", "tags", "meta"}
NEUTRAL = {"content", "article", "post", "entry", "story", "main", "body", "text", "page", "wrapper", "container"}
PARAGRAPH = {"p", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "center"}
HEADLINE = {"h1", "h2", "h3"}
ROWS = {"ul", "ol", "dl", "dt", "dd", "li", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption"}
MAIN = {"article", "main"}
LEFT_OPEN = {"nav", "header", "footer", "form"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?=[\s=/]|$)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CLASS = re.compile(r"[A-Za-z_-]+(?=\s|\Z)")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


def _element(name: str, attributes: str, in_main: bool) -> tuple[bool, bool, str]:
    """Whether an element is no part of the article by its name, whether it is an article itself, and its label."""
    apart = name in APART or (name == "header" and not in_main)
    main = name in MAIN
    label = f"<{name}>"
    if attributes.strip() and name not in ("html", "body"):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        role = found.get("role", "").lower()
        main = main or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
        apart = apart or role in ROLES
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            apart = True
        shown = found.get("class", "")
        words = {w.lower() for w in _WORDS.findall(shown + " " + found.get("id", ""))}
        if words & STRONG:
            apart = True
        elif words & WEAK and not words & NEUTRAL and not main and not in_main:
            apart = True
        elif in_main and words & (WEAK - {"header", "side", "meta", "tags", "banner"}) and not words & NEUTRAL:
            apart = True
        first = _CLASS.match(shown.lstrip())
        if first:
            label = f"<{name}.{first[0]}>"
    return apart, main, label


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(text.split()).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """Symbols of a page's token stream, and its texts with their place and context."""

    __slots__ = ("symbols", "texts", "at", "before", "path", "apart", "main", "linked", "headline", "glue")

    def __init__(self, source: str):
        self.symbols: list[str] = []
        self.texts: list[str] = []
        self.at: list[int] = []  # place among the symbols
        self.before: list[str] = []  # the tag before the text
        self.path: list[str] = []  # labels of the open elements that are neither rows, paragraphs nor inline
        self.apart: list[bool] = []
        self.main: list[bool] = []
        self.linked: list[bool] = []  # a block of mostly linked text
        self.headline: list[bool] = []
        self.glue: list[bool] = []  # no block ends between this text and the one before
        stack: list[tuple[str, bool, bool, str]] = []  # name, apart, main, path outside
        opened: Counter = Counter()
        apart = main = anchors = headlines = 0
        broken, run = True, False
        last, path = "^", ""
        pos, n = 0, len(source)

        def leave() -> str:
            nonlocal apart, main, anchors, headlines, path
            name, was_apart, was_main, path = stack.pop()
            opened[name] -= 1
            apart, main, anchors, headlines = apart - was_apart, main - was_main, anchors - (name == "a"), headlines - (name in HEADLINE)
            return name

        while pos < n:
            found = _TAG.search(source, pos)
            end = found.start() if found else n
            if end > pos:
                text = source[pos:end]
                if text.strip():
                    if not run:
                        self.symbols.append("#")
                        run = True
                    self.at.append(len(self.symbols) - 1)
                    self.before.append(last)
                    self.path.append(path)
                    self.texts.append(entities.unescape(text) if "&" in text else text)
                    self.apart.append(apart > 0)
                    self.main.append(main > 0)
                    self.linked.append(anchors > 0)
                    self.headline.append(headlines > 0)
                    self.glue.append(not broken)
                    broken = False
                elif self.texts:
                    self.texts[-1] += " "
            if not found:
                break
            pos = found.end()
            closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            name = name.lower()
            block = name not in INLINE
            if block:
                broken = True
            token = block and name not in PARAGRAPH
            if closing:
                if opened[name]:
                    while leave() != name:
                        pass
                    last = f"</{name}>"
                    if token:
                        self.symbols.append(last)
                        run = False
                continue
            if name in MAIN and apart and all(s[0] in LEFT_OPEN for s in stack if s[1]):
                while apart:  # an article ends a menu, header or footer that was left open
                    leave()
            is_apart, is_main, label = _element(name, attributes, main > 0)
            last = label
            if token:
                self.symbols.append(label)
                run = False
            if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
                continue
            stack.append((name, is_apart or name in RAW, is_main, path))
            opened[name] += 1
            apart, main, anchors, headlines = apart + (is_apart or name in RAW), main + is_main, anchors + (name == "a"), headlines + (name in HEADLINE)
            if token and name not in ROWS:
                path += label
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, pos)
                pos = close.start() if close else n
        self._whole_blocks()

    def _whole_blocks(self) -> None:
        """Marks as linked the texts of blocks that are mostly so."""
        first = 0
        for k in range(1, len(self.texts) + 1):
            if k == len(self.texts) or not self.glue[k]:
                size = [len(t.strip()) for t in self.texts[first:k]]
                most = 2 * sum(n for n, linked in zip(size, self.linked[first:k]) if linked) > sum(size)
                self.linked[first:k] = [most] * (k - first)
                first = k

    def outline(self) -> tuple[str, list[int]]:
        """What inference reads, as JSON, and the keys of the texts."""
        keys = list(map(_key, self.texts))
        names: dict[str, int] = {}
        number = lambda name: names.setdefault(name, len(names))
        texts = [
            [at, number(before), number(path), key, len(text.strip()), linked and not headline, apart, headline]
            for at, before, path, key, text, linked, apart, headline in zip(self.at, self.before, self.path, keys, self.texts, self.linked, self.apart, self.headline)
        ]
        return json.dumps([self.symbols, list(names), texts], separators=(",", ":")), keys


def _fold(keys: list[str], groups: set[str]) -> tuple[list[str], list[int]]:
    """Folds tandem repeats, and single occurrences of known groups, until nothing changes.

    Returns the folded keys and, for each symbol, the folded node that covers it.
    """
    alphabet: dict[str, str] = {}
    names: list[str] = []

    def letter(key: str) -> str:
        if key not in alphabet:
            alphabet[key] = chr(0xE000 + len(names)) if len(names) < 6000 else chr(0xF0000 + len(names))
            names.append(key)
        return alphabet[key]

    def name(c: str) -> str:
        return names[ord(c) - (0xE000 if ord(c) < 0xF0000 else 0xF0000)]

    text = "".join(map(letter, keys))
    spans = [1] * len(text)

    def replace(pattern: re.Pattern, text: str, spans: list[int], key_of) -> tuple[str, list[int]]:
        out, sizes, last = [], [], 0
        for m in pattern.finditer(text):
            out.append(text[last : m.start()])
            sizes += spans[last : m.start()]
            out.append(letter(key_of(m)))
            sizes.append(sum(spans[m.start() : m.end()]))
            last = m.end()
        if not last:
            return text, spans
        return "".join(out) + text[last:], sizes + spans[last:]

    while True:
        before = text
        text, spans = replace(_REPEAT, text, spans, lambda m: "(" + "".join(map(name, m[1])) + ")+")
        for group in sorted(groups, key=len):
            parts = _parts(group)
            if all(p in alphabet for p in parts):
                inner = re.escape("".join(alphabet[p] for p in parts))
                both = f"(?:{inner}|{re.escape(alphabet[group])})+" if group in alphabet else f"(?:{inner})+"
                text, spans = replace(re.compile(both), text, spans, lambda m, g=group: g)
        if text == before:
            break
        if len(text) < 2:
            break
    cover = [k for k, size in enumerate(spans) for _ in range(size)]
    return list(map(name, text)), cover


_REPEAT = re.compile(rf"(.{{1,{LONGEST_GROUP}}}?)\1+", re.S)
_PART = re.compile(r"#|<[^>]*>")


def _parts(group: str) -> list[str]:
    """Top-level keys inside a group's name `(...)+`."""
    out, depth, start = [], 0, 0
    inner = group[1:-2]
    k = 0
    while k < len(inner):
        c = inner[k]
        if c == "(":
            if not depth:
                start = k
            depth += 1
            k += 1
        elif c == ")":
            depth -= 1
            k += 2  # with its plus sign
            if not depth:
                out.append(inner[start:k])
        else:
            m = _PART.match(inner, k)
            if not depth:
                out.append(m[0])
            k = m.end()
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence as pairs of places; common ends are matched first."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    pairs = [(k, k) for k in range(lo)]
    pairs += [(lo + i, lo + j) for i, j in (_longest(x, y) if len(x) * len(y) <= ALIGNED_CELLS else _anchored(x, y))]
    return pairs + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def _longest(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    pairs, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _anchored(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A common subsequence of very long streams: symbols that either has once, in rising order, and between them the longest
    one, or where that is still too much what a single walk finds."""
    once_x = {c for c, n in Counter(x).items() if n == 1}
    once = once_x & {c for c, n in Counter(y).items() if n == 1}
    place = {c: i for i, c in enumerate(x) if c in once}
    tails: list[tuple[int, int]] = []  # by length the least end of a rising run, with its place
    back: list[tuple[int, int, int]] = []  # x, y, previous
    for j, c in enumerate(y):
        if c in once:
            i = place[c]
            k = bisect.bisect_left(tails, (i, -1))
            back.append((i, j, tails[k - 1][1] if k else -1))
            tails[k : k + 1] = [(i, len(back) - 1)]
    anchors, at = [], tails[-1][1] if tails else -1
    while at >= 0:
        anchors.append(back[at][:2])
        at = back[at][2]
    found, i, j = [], 0, 0
    for p, q in [*reversed(anchors), (len(x), len(y))]:
        if (p - i) * (q - j) <= ALIGNED_CELLS:
            found += [(i + u, j + v) for u, v in _longest(x[i:p], y[j:q])]
        else:
            where: dict[str, list[int]] = defaultdict(list)
            for v in range(j, q):
                where[y[v]].append(v)
            v = j
            for u in range(i, p):
                k = bisect.bisect_left(where[x[u]], v)
                if k < len(where[x[u]]) and where[x[u]][k] - v <= 64:
                    found.append((u, where[x[u]][k]))
                    v = where[x[u]][k] + 1
        if p < len(x):
            found.append((p, q))
        i, j = p + 1, q + 1
    return found


# A slot: [pages, texts, frequent texts, characters, characters of linked blocks, {frequent text: pages}, {path: [own, template, headline characters]}]
def _merge_slot(a: list | None, b: list) -> list:
    if not a:
        return b
    counts = dict(a[5])
    for k, n in b[5].items():
        counts[k] = counts.get(k, 0) + n
    paths = dict(a[6])
    for k, v in b[6].items():
        paths[k] = [x + y for x, y in zip(paths[k], v)] if k in paths else v
    return [*(x + y for x, y in zip(a[:5], b[:5])), counts, paths]


class Wrapper:
    """Keys of the nodes, which of them are optional, and the slots of each by the tag before a text. `pages` are distinct."""

    def __init__(self, keys=(), optional=(), slots=(), pages=0):
        self.keys, self.optional, self.slots = list(keys), list(optional), list(slots)
        self.pages = pages
        self.places: dict[tuple, list] = {}
        self.groups = {k for k in self.keys if k[0] == "("}
        self._region: str | None = None

    def _take(self, keys: list[str]) -> list[int]:
        """Aligns folded keys; extends the wrapper by what it lacks. Returns the node of each key."""
        if not self.keys:
            self.keys, self.optional, self.slots = list(keys), [False] * len(keys), [{} for _ in keys]
            self.groups = {k for k in keys if k[0] == "("}
            return list(range(len(keys)))
        new = {k for k in keys if k[0] == "("} - self.groups
        if new:
            self._refold(new)
        pairs = _common(self.keys, keys)
        merged: list[tuple[str, bool, dict]] = []
        place = [0] * len(keys)
        i = j = 0
        for a, b in [*pairs, (len(self.keys), len(keys))]:
            merged += [(self.keys[k], True, self.slots[k]) for k in range(i, a)]
            for k in range(j, b):
                place[k] = len(merged)
                merged.append((keys[k], True, {}))
            if a < len(self.keys):
                place[b] = len(merged)
                merged.append((self.keys[a], self.optional[a], self.slots[a]))
            i, j = a + 1, b + 1
        if len(merged) != len(self.keys):
            self.places.clear()
        self.keys, self.optional, self.slots = (list(x) for x in zip(*merged))
        return place

    def _refold(self, new: set[str]) -> None:
        """Folds the wrapper's own nodes by groups that another stream has shown."""
        self.groups |= new
        keys, cover = _fold(self.keys, self.groups)
        if len(keys) == len(self.keys):
            return
        optional, slots = [True] * len(keys), [{} for _ in keys]
        for k, node in enumerate(cover):
            optional[node] = optional[node] and self.optional[k]
            for before, slot in self.slots[k].items():
                slots[node][before] = _merge_slot(slots[node].get(before), slot)
        self.keys, self.optional, self.slots = keys, optional, slots
        self.groups |= {k for k in keys if k[0] == "("}
        self.places.clear()

    def locate(self, symbols: list[str], learn: bool) -> list[int | None]:
        """The node of each symbol, or None."""
        shape = tuple(symbols)
        found = self.places.get(shape)
        if found is None:
            keys, cover = _fold(symbols, self.groups)
            place: list[int | None]
            if learn:
                place = list(self._take(keys))
            else:
                place = [None] * len(keys)
                for a, b in _common(self.keys, keys):
                    place[b] = a
            found = [place[c] for c in cover]
            if len(self.places) > 2000:
                self.places.clear()
            self.places[shape] = found
        return found

    def add(self, outline: str, frequent: set[int]) -> None:
        """Takes in a page, given by its outline, that is not the same as one before."""
        symbols, names, texts = json.loads(outline)
        self.pages += 1
        nodes = self.locate(symbols, True)
        seen: dict[tuple[int, str], list] = {}
        for at, before, path, key, size, linked, apart, headline in texts:
            slot = seen.setdefault((nodes[at], names[before]), [1, 0, 0, 0, 0, {}, {}])
            slot[1] += 1
            slot[3] += size
            slot[4] += size * linked
            if key in frequent:
                slot[2] += 1
                slot[5][str(key)] = 1
            own = not (key in frequent or linked or apart)
            mass = slot[6].setdefault(names[path], [0, 0, 0])
            mass[0 if own else 1] += size
            mass[2] += size * (own and headline)
        for (node, before), slot in seen.items():
            slots = self.slots[node]
            slots[before] = _merge_slot(slots.get(before), slot)

    def merge(self, other: Wrapper) -> None:
        lacking = self.groups - other.groups
        if lacking and self.keys:
            other._refold(lacking)
        for node, own, optional in zip(self._take(other.keys), other.slots, other.optional):
            self.optional[node] = self.optional[node] or optional
            for before, slot in own.items():
                self.slots[node][before] = _merge_slot(self.slots[node].get(before), slot)
        self.pages += other.pages

    def region(self) -> str:
        """Path of the innermost element that holds nearly all own text and leaves mostly template behind."""
        if self._region is None:
            under: dict[str, list[int]] = {}
            inner: dict[str, set[str]] = defaultdict(set)
            for slots in self.slots:
                for slot in slots.values():
                    for path, mass in slot[6].items():
                        at = ""
                        under[at] = [x + y for x, y in zip(under.get(at, (0, 0, 0)), mass)]
                        for label in _PART.findall(path):
                            inner[at].add(at + label)
                            at += label
                            under[at] = [x + y for x, y in zip(under.get(at, (0, 0, 0)), mass)]
            at = ""
            while inner[at]:
                best = max(sorted(inner[at]), key=lambda p: under[p][0])
                own, template, headline = (x - y for x, y in zip(under[at], under[best]))
                bare = own == 0 and template == 0  # the same texts, one element further in
                if under[best][0] < REGION_SHARE * under[""][0] or not under[best][0] or not bare and (template <= own or 10 * headline > under[""][2]):
                    break
                at = best
            self._region = at
        return self._region

    def is_template(self, node: int | None, page: Page, k: int) -> bool:
        """Whether the slot of a page's text says that it is no part of the article."""
        slot = None if node is None else self.slots[node].get(page.before[k])
        if not slot or slot[0] < EVIDENCE:
            return False
        same = slot[5].get(str(_key(page.texts[k])), 0)
        main = page.main[k] and not page.apart[k]
        if same >= FREQUENT_PAGES and (same >= (TEMPLATE_TEXT_MAIN if main else TEMPLATE_TEXT) * slot[0] or not main and slot[2] >= TEMPLATE_SLOT * slot[1]):
            return True
        return page.linked[k] and not page.headline[k] and 2 * slot[4] > slot[3] and (not main or self.keys[node][0] == "(")

    def dump(self) -> str:
        return json.dumps([self.keys, self.optional, self.slots, self.pages], separators=(",", ":"))

    @staticmethod
    def load(text: str | None) -> Wrapper:
        return Wrapper(*json.loads(text)) if text else Wrapper()

    def expression(self) -> str:
        """The wrapper as a union-free regular expression."""
        return "".join(f"({k})?" if o else k for k, o in zip(self.keys, self.optional))


def main_text(source: str | None, wrapper: Wrapper) -> str:
    if not source:
        return ""
    page = Page(source)
    inside = any(m and not a for m, a in zip(page.main, page.apart))
    known = wrapper.pages >= EVIDENCE
    nodes = wrapper.locate(page.symbols, False) if known else None
    region = wrapper.region() if known else ""
    if not any(p.startswith(region) for p in page.path):
        region = ""  # a page of another layout
    kept = []
    for k in range(len(page.texts)):
        if known and wrapper.is_template(nodes[page.at[k]], page, k) or not page.path[k].startswith(region):
            continue
        if page.apart[k] or (inside and not page.main[k]):
            continue
        kept.append(("" if page.glue[k] and kept else " ") + page.texts[k])
    return " ".join("".join(kept).split())


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[^:]*://([^/?#]*)", 1), F.lit("")))


_OUTLINES = T.StructType([T.StructField("host", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("outline", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType()))])
_WRAPPER = "host string, bucket long, wrapper string"


def _outlines(batches):
    """Outline of each page (host, html) that has a text, with the digest of its texts and their distinct keys."""
    schema = to_arrow_schema(_OUTLINES)
    for batch in batches:
        rows = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
            if source.is_valid and len(source.as_buffer()):
                outline, keys = Page(source.as_py()).outline()
                if keys:
                    rows.append((host, hashlib.blake2b(repr(keys).encode(), digest_size=16).digest(), outline, list(set(keys))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _infer(key, pages, frequent):
    import pandas as pd

    every, known = Wrapper(), {k for keys in frequent["keys"] for k in keys}
    for outline in pages.sort_values("digest")["outline"]:
        every.add(outline, known)
    return pd.DataFrame({"host": [key[0]], "bucket": [key[1]], "wrapper": [every.dump()]}) if len(pages) else pd.DataFrame({"host": [], "bucket": [], "wrapper": []})


def _merge_group(key, frame):
    import pandas as pd

    every = Wrapper()
    for text in frame.sort_values("bucket")["wrapper"]:
        every.merge(Wrapper.load(text))
    return pd.DataFrame({"host": [key[0]], "bucket": [key[1]], "wrapper": [every.dump()]})


def infer_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", bucket_pages: int = BUCKET_PAGES) -> DataFrame:
    """(host, wrapper) over all pages. Computed when this returns."""
    spark, path = pages.sparkSession, scratch(pages.sparkSession, "outlines")
    rows = small_batches(pages).select(_host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    # copies in all tasks are one page before anything is counted
    same = rows.mapInArrow(_outlines, _OUTLINES).groupBy("host", "digest")
    same.agg(F.min("outline").alias("outline"), F.min("keys").alias("keys")).write.parquet(path)
    distinct = spark.read.parquet(path)
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    texts = distinct.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= FREQUENT_PAGES)
    # a page has few texts, so few can be on a share of a host's pages
    frequent = texts.join(hosts, "host").where(100 * F.col("seen") >= FREQUENT_PERCENT * F.col("n")).groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    buckets = F.ceil(F.col("n") / bucket_pages).cast("long")
    known = cut(hosts.join(frequent, "host", "left").select("host", buckets.alias("buckets"), F.coalesce("keys", F.array().cast("array<long>")).alias("keys")))
    dealt = distinct.select("host", "digest", "outline").join(known.select("host", "buckets"), "host").withColumn("bucket", F.pmod(F.xxhash64("digest"), F.col("buckets"))).drop("buckets")
    each = known.select("host", "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    found = dealt.groupBy("host", "bucket").cogroup(each.groupBy("host", "bucket")).applyInPandas(_infer, _WRAPPER)
    left = known.agg(F.max("buckets")).first()[0] or 0
    while left > 1:
        found = found.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).groupBy("host", "bucket").applyInPandas(_merge_group, _WRAPPER)
        left = -(-left // FAN_IN)
    found = cut(found.select("host", "wrapper"))
    drop_path(spark, path)
    return found


def extract(pages: DataFrame, wrappers: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page, read through its host's wrapper."""
    rows = small_batches(pages).select(F.col(id_col), F.col(url_col), _host(F.col(url_col)).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    known = wrappers.withColumnsRenamed({"host": "_of", "wrapper": "_wrapper"})
    # small sets of wrappers go to every task, larger ones are joined by host, where adaptive execution splits a hot one
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, F.col("_host") == F.col("_of"), "left").select(id_col, url_col, "_host", "_html", "_wrapper")
    schema = T.StructType([joined.schema[id_col], joined.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        arrow = to_arrow_schema(schema)
        read: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for host, source, wrapper in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if host not in read:
                    if len(read) > 2000:
                        read.clear()
                    read[host] = Wrapper.load(wrapper.as_py())
                texts.append(main_text(source.as_py(), read[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return joined.mapInArrow(run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, infer_wrappers(pages))
