"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tags and runs of text: a word scores positive, a tag negative.  How
much a tag costs is learned from labelled pages, those that mark their content with an
``article`` or ``main`` element: the log-odds of the tag outside of the content, times a factor
chosen for the best token F1 on the same pages.  A linear scan finds the best
contiguous region.  Parts that are never content score nothing, so that one inside of an article doesn't end it, and are left out of
the region's text; so do the tags in them.  The tags that mark content themselves are borders and cost ``BORDER_COST``.

Never content are: menus, headers, footers, sidebars, forms and the like by element or role, hidden parts, and
parts whose class or id says so.  A class or id counts as a whole name: one that is made of `_STRONG` words (a
``site-footer``, but not ``related-work`` or ``has-sidebar``), or one that the labelled pages have outside of their
content only (log-odds of `CLASS_ODDS` or more).  No name excludes a part that holds the marked
content, a main heading or most of the page's words, and no element but a hidden one a part that holds the marked content; a form
may hold most of the words, too.

Text: character references decoded, white space inside a block as one space, blocks in page
order joined by two newlines; nothing else is dropped or cut.

Defined cases: a null or empty page, or one without words, has an empty text; a null url or page_id stays null;
unclosed elements end with their parent; a comment, script or tag that is never closed reaches to the page's end;
a page is scanned once, whatever its length and however deep its elements stand, and takes memory for each
tag and run of text, not for each word; repeated rows are judged alike; of equal regions the first counts; without labelled
pages every tag costs ``DEFAULT_COST``; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 300
SAMPLE_BYTES = 100_000
DEFAULT_COST = 0.2
FACTORS = (0.05, 0.2, 0.5, 1.0, 2.0, 4.0, 8.0)
BORDER_COST = 50.0
_BORDERS = ("article", "main")

_RAW = frozenset("script style noscript template textarea iframe object svg xmp title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("nav footer aside menu button select label input dialog search".split())
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id that mark a part as no content.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " footer masthead sidebar comments commentlist disqus cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login"
    " pagination pager toolbar".split()
)
#: Words that may stand beside them in one name, and say nothing alone.
_BESIDE = frozenset(
    "header banner side widget comment reply replies respond discussion overlay subscription share sharing social related recommended hidden skip"
    " box list section wrapper wrap container area block inner item items bar link links top bottom left right site page post posts article entry slot unit group main primary secondary".split()
)
CLASS_ODDS = 3.0
_P_ENDS_BEFORE = _BLOCK - {"body", "html"}
_ATTRS = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[\W_]+|(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, open or close."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], ""
        if lt == n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = m.end()
        while end < n and page[end] != ">":
            if page[end] in "\"'" and page[end - 1] in "= \t\n":
                end = page.find(page[end], end + 1)
                if end < 0:
                    end = n
                    break
            end += 1
        name, attrs = m[0].lower(), page[m.end() : end]
        at = end + 1
        if name[0] == "/":
            yield "close", name[1:], ""
            continue
        yield "open", name, attrs
        if name in _RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else n
            yield "close", name, ""


#: What may exclude an element: a hidden one and all in it, an element as such, a form, its names.
_HIDDEN, _ELEMENT, _FORM, _NAMED = 1, 2, 3, 4


def _names(found: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id") for w in found.get(k, "").split()}


def _strong(name: str) -> bool:
    parts = {w.lower() for w in _WORDS.split(name) if w}
    return not parts.isdisjoint(_STRONG) and parts <= _STRONG | _BESIDE


class Page:
    """A page's tags and runs of text, and the elements that they stand in.

    ``items`` has (tag or None, text, words, block, element) of each.
    """

    def __init__(self, page: str, odds: dict[str, float]):
        self.items: list[tuple[str | None, str, int, int, int]] = []
        # the elements, in the order in which they open; 0 is the page
        self.parent, self.why, self.words, self.holds, self.titled, self.marked = [0], [0], [0], [False], [False], [False]
        self.names: dict[int, set[str]] = {}
        stack, tags, opened = [0], [""], Counter()
        block, gap = 0, True
        for kind, value, attrs in scan(page):
            if kind == "text":
                text = html.unescape(value) if "&" in value else value
                words = text.split()
                if not words:
                    gap = gap or bool(text)
                    continue
                gap = gap or text[0].isspace()
                self.items.append((None, (" " if gap else "") + " ".join(words), len(words), block, stack[-1]))
                self.words[stack[-1]] += len(words)
                gap = text[-1].isspace()
                continue
            if kind == "open":
                if tags[-1] == "p" and value in _P_ENDS_BEFORE or tags[-1] == value and value in ("li", "td", "th", "tr", "dt", "dd", "option"):
                    opened[tags.pop()] -= 1
                    stack.pop()
                here = self._element(value, attrs, stack[-1], odds)
                self.items.append((value, "", 0, block, here))
                if value not in _VOID and not attrs.endswith("/"):
                    stack.append(here)
                    tags.append(value)
                    opened[value] += 1
            else:
                self.items.append((value, "", 0, block, stack[-1]))
                while opened[value]:
                    opened[tags[-1]] -= 1
                    stack.pop()
                    if tags.pop() == value:
                        break
            if value in _BLOCK:
                block += 1
                gap = True
            elif value in ("br", "wbr", "img"):
                gap = True
        for i in range(len(self.parent) - 1, 0, -1):
            up = self.parent[i]
            self.words[up] += self.words[i]
            self.holds[up] |= self.holds[i]
            self.titled[up] |= self.titled[i]
        self.excluded = [False] * len(self.parent)
        for i in range(1, len(self.parent)):
            self.excluded[i] = self.excluded[self.parent[i]] or self._never(i)

    def _element(self, name: str, attrs: str, parent: int, odds: dict[str, float]) -> int:
        here, inside = len(self.parent), self.marked[parent]
        border = name in _BORDERS
        why = _HIDDEN if name in _RAW or name == "head" else _FORM if name == "form" else _ELEMENT if name in _NEVER or (name == "header" and not inside) else 0
        if attrs and not why == _HIDDEN:
            found = {k.lower(): v.strip("\"'") for k, v in _ATTRS.findall(attrs)}
            if "hidden" in found or found.get("aria-hidden") == "true" or _UNSEEN.search(found.get("style", "")):
                why = _HIDDEN
            elif not why and found.get("role", "").lower() in _NEVER_ROLES:
                why = _ELEMENT
            elif not why and not border and name not in ("body", "html"):
                names = _names(found)
                if names:
                    self.names[here] = names
                    if any(_strong(w) or odds.get(w, 0.0) >= CLASS_ODDS for w in names):
                        why = _NAMED
        self.parent.append(parent)
        self.why.append(why)
        self.words.append(0)
        self.holds.append(border)
        self.titled.append(name == "h1")
        self.marked.append(inside or border)
        return here

    def _never(self, i: int) -> bool:
        why = self.why[i]
        if why in (0, _HIDDEN):
            return why == _HIDDEN
        most = 2 * self.words[i] > self.words[0]
        return not (self.holds[i] or (why in (_FORM, _NAMED) and most) or (why == _NAMED and self.titled[i]))


class Costs:
    """What each tag costs, and how much more often a class or id stands outside of the content (log-odds)."""

    def __init__(self, pages: list[str]):
        self.cost: dict[str, float] = {}
        self.odds: dict[str, float] = {}
        self.default = DEFAULT_COST
        read = [x for x in (Page(p or "", {}) for p in pages) if any(x.marked)]
        if not read:
            return
        names: tuple[Counter, Counter] = (Counter(), Counter())
        for x in read:
            for i, found in x.names.items():
                names[x.marked[i]].update(found)
        self.odds = {w: math.log((names[0][w] + 0.5) / (names[1][w] + 0.5)) for w in {*names[0], *names[1]}}
        kept = [Page(p or "", self.odds) for p in pages]
        kept = [x for x in kept if any(x.marked)]
        inside: Counter = Counter()
        outside: Counter = Counter()
        for x in kept:
            for tag, _, _, _, e in x.items:
                if tag is not None:
                    (inside if x.marked[e] else outside)[tag] += 1
        odds = {v: math.log((outside[v] + 0.5) / (inside[v] + 0.5) * (sum(inside.values()) + 1) / (sum(outside.values()) + 1)) for v in {*inside, *outside}}
        best = -1.0
        for factor in FACTORS:
            self.cost = {v: factor * max(o, 0.0) + 0.01 for v, o in odds.items()} | dict.fromkeys(_BORDERS, BORDER_COST)
            f1 = sum(self._f1(x) for x in kept) / len(kept)
            if f1 > best + 1e-9:
                best, chosen = f1, dict(self.cost)
        self.cost = chosen

    def _f1(self, page: Page) -> float:
        a, b = self.region(page)
        got = want = both = 0
        for i, (_, _, n, _, e) in enumerate(page.items):
            if n and not page.excluded[e]:
                got += n * (a <= i < b)
                want += n * page.marked[e]
                both += n * (a <= i < b and page.marked[e])
        return 2 * both / (got + want) if got or want else 1.0

    def region(self, page: Page) -> tuple[int, int]:
        """Start and end of the contiguous items with the largest score; the first such."""
        best = total = 0.0
        span = (0, 0)
        begin = 0
        for i, (tag, _, words, _, e) in enumerate(page.items):
            if page.excluded[e]:
                continue
            total += words if tag is None else -self.cost.get(tag, self.default)
            if total <= 0:
                total, begin = 0.0, i + 1
            elif total > best:
                best, span = total, (begin, i + 1)
        return span

    def extract(self, html_text: str | None) -> str:
        page = Page(html_text or "", self.odds)
        a, b = self.region(page)
        if a == b:
            return ""
        # a block is text as a whole: the region reaches to the ends of its first and last one
        first, last = page.items[a][3], page.items[b - 1][3]
        blocks: dict[int, list[str]] = {}
        for _, text, words, block, e in page.items:
            if words and first <= block <= last and not page.excluded[e]:
                blocks.setdefault(block, []).append(text)
        return "\n\n".join("".join(texts).strip() for texts in blocks.values())


def labelled_pages(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> list[str]:
    """A bounded sample of pages that mark their content, those with the smallest hashes."""
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]") & (F.length(html_col) <= SAMPLE_BYTES))
    # the hashes first: a limit sends its rows from every partition to the driver
    hashes = [r.h for r in marked.select(F.xxhash64(html_col).alias("h")).orderBy("h").limit(sample_pages).collect()]
    if not hashes:
        return []
    chosen = marked.where(F.xxhash64(html_col).isin(hashes)).select(html_col).distinct()
    return sorted(r[0] for r in chosen.collect())


def extract_text(pages: DataFrame, sample: list[str], html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(Costs(sample))  # numbers for the tags and names of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = [costs.extract(x.as_py()) for x in piece["html"]]
                yield pa.RecordBatch.from_pydict({"page_id": piece["page_id"], "url": piece["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
