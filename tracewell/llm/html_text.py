"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, with weights learned from labelled pages: those
that mark their article themselves (``article``, ``main``, ``role=main`` or ``itemprop=articleBody``). Elements are weighed too, by
tag, class, id and role: what stands beside articles on labelled pages is negative, and is left out wherever it stands. Names
of boilerplate start at negative log-odds, which labelled pages confirm or outweigh. One linear scan finds the contiguous region
with the largest sum.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._shared import unit_hash

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)|[^<]+|<", re.S)
_RAW = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "title", "xmp", "noembed", "noframes")}
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|aria-label)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_DROP = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "head", "object", "audio", "video", "canvas", "map", "datalist"}
_DROP_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|promo\w*|sponsor\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|topbar|announcement|disclaimer|comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|skip-link)(?=$|[\s_-])",
    re.I,
)
#: Says what a layout has or lacks, as in ``with-sidebar``; the element is not that thing itself.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:with|without|has|no)[_-]\S*", re.I)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?=$|[\s_-])", re.I)
_PAGE_HEADER = re.compile(r"(?:^|\s)(?:global-|main-|top-)?header(?=$|\s)", re.I)
_DROP_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
#: Elements that don't end an open head.
_IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Elements whose start closes an open p.
_ENDS_P = _BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value) in page order: ``text``, ``open`` with the attributes, ``close``. Comments, declarations and the
    content of scripts, styles and the like are left out. A page that ends inside a tag or comment ends before it."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        first = m[0][0]
        if m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
            elif name in _RAW and not m[3].rstrip().endswith("/"):
                stop = _RAW[name].search(page, at)
                at = stop.end() if stop else end
            else:
                yield "open", name, m[3]
        elif first != "<" or len(m[0]) == 1:
            yield "text", "", m[0]
        elif m[0].startswith("<![CDATA["):
            yield "text", "", m[0][9:].removesuffix("]]>")


def _marked(name: str, attrs: str) -> bool:
    if name in ("article", "main"):
        return True
    pairs = [(k.lower(), v.strip("\"'").lower().split()) for k, v in _ATTR.findall(attrs)] if attrs else []
    return any(k == "itemprop" and "articlebody" in v or k == "role" and "main" in v for k, v in pairs)


def _hidden(attrs: str) -> bool:
    return any(k.lower() == "hidden" and not v or k.lower() == "aria-hidden" and v.strip("\"'").lower() == "true" for k, v in _ATTR.findall(attrs))


def features(name: str, attrs: str) -> list[str]:
    """What an element is judged by: its tag, and each word of its class, id and role (``.word``, ``@role``)."""
    out = [name]
    for key, value in _ATTR.findall(attrs) if attrs else ():
        key = key.lower()
        if key in ("class", "id", "role"):
            out += [("@" if key == "role" else ".") + w for w in value.strip("\"'").lower().split()]
    return out


def prior(feature: str) -> float:
    """The log-odds of content before any page is seen: ``-PRIOR`` for names of boilerplate, else 0."""
    if feature[0] == "@":
        bad = feature[1:] in _DROP_ROLE
    elif feature[0] == ".":
        word = _LAYOUT.sub("", feature[1:])
        bad = bool(_DROP_NAME.search(word))
    else:
        bad = feature in _DROP
    return -PRIOR if bad else 0.0


#: Log-odds of a boilerplate name before any page is seen; twenty labelled elements against it outweigh it.
PRIOR = 3.0
#: Key of the elements' weights among the tags' and words' weights.
ELEMENTS = "elements"


class Judge:
    """Weighs elements by the log-odds, learned from labelled pages, that what they hold is content; the least of their features' counts."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.known: dict[tuple[str, str, bool], float] = {}

    def weight(self, name: str, attrs: str, in_article: bool) -> float:
        key = (name, attrs, in_article)
        found = self.known.get(key)
        if found is None:
            found = self._weight(name, attrs, in_article)
            if len(self.known) < 10_000:
                self.known[key] = found
        return found

    def _weight(self, name: str, attrs: str, in_article: bool) -> float:
        if name == "head" or attrs and _hidden(attrs):
            return -PRIOR
        marked = _marked(name, attrs)
        own = []
        for f in features(name, attrs):
            if f[0] == "." and (marked or name in ("html", "body")):
                if name == "article" and _COMMENT.search(_LAYOUT.sub("", f[1:])):
                    own.append(-PRIOR)
                continue
            value = self.learned.get(f, 0.0) + prior(f)
            if not in_article and (f == "header" or f[0] == "." and _PAGE_HEADER.search(_LAYOUT.sub("", f[1:]))):
                value -= PRIOR
            own.append(value)
        return min(own, default=0.0)


def walk(page: str, judge: Judge | None = None) -> Iterator[tuple[str, str, str, bool, float, int]]:
    """Tokens with whether they stand in a marked article, the weight of the boilerplate they stand in (0 outside of any), and
    the number of the element they stand in (elements are numbered from 1 as they open).

    Boilerplate is an element with a weight below zero and all within. The first marked article of a page counts even inside an
    element whose name looks like boilerplate (``sidebar-layout``). An open head ends where an element or words begin that can't
    stand in it.
    """
    stack: list[tuple[str, bool, float, int]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each name in the stack
    blocks: list[int] = []
    met, number = False, 0
    outermost = ("", False, 0.0, 0)

    def close(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop()[0]
            places[name].pop()
            if name in _BLOCK:
                blocks.pop()

    for kind, name, value in tokens(page):
        top = stack[-1] if stack else outermost
        if top[0] == "head" and (kind == "open" and name not in _IN_HEAD or kind == "text" and not value.isspace()):
            close(len(stack) - 1)
            top = stack[-1] if stack else outermost
        if kind == "open":
            if name in _ENDS_P and top[0] == "p" or name == top[0] and name in ("li", "option", "dt", "dd", "td", "th", "tr"):
                close(len(stack) - 1)
                top = stack[-1] if stack else outermost
            own = min(0.0, judge.weight(name, value, top[1])) if judge else 0.0
            first = not own and not met and _marked(name, value) and not any(places[d] for d in _DROP)
            met = met or first
            inside, bad = top[1] or _marked(name, value), min(own, 0.0 if first else top[2])
            number += 1
            yield kind, name, value, inside, bad, top[3]
            if name not in _VOID and not value.rstrip().endswith("/"):
                places[name].append(len(stack))
                if name in _BLOCK:
                    blocks.append(len(stack))
                stack.append((name, inside, bad, number))
        elif kind == "close":
            yield kind, name, value, *top[1:]
            if places[name] and (name in _BLOCK or not blocks or blocks[-1] < places[name][-1]):
                close(places[name][-1])
        else:
            yield kind, name, value, *top[1:]


def _labelled_elements(page: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(name, attributes) of the elements that hold the page's first marked article or stand in it, and of the largest elements
    with words that do neither; none without a marked article."""
    nodes: list[tuple[str, str, int]] = [("", "", 0)]
    words = [False]
    article = 0
    for kind, name, value, _, _, parent in walk(page):
        if kind == "open":
            nodes.append((name, value, parent))
            words.append(False)
            if not article and _marked(name, value):
                article = len(nodes) - 1
        elif kind == "text" and not value.isspace():
            words[parent] = True
    for k in range(len(nodes) - 1, 0, -1):
        words[nodes[k][2]] |= words[k]
    around, k = {0}, article
    while k:
        around.add(k)
        k = nodes[k][2]
    within, good, bad = [False] * len(nodes), [], []
    for k in range(1, len(nodes) if article else 0):
        name, attrs, parent = nodes[k]
        within[k] = k == article or within[parent]
        if within[k] or k in around:
            good.append((name, attrs))
        elif parent in around and words[k] and name != "head":
            bad.append((name, attrs))
    return good, bad


def fit_weights(pages: list[str]) -> dict:
    """Weights of tags, each below zero, of a word (key ``""``), and of elements' features (key ``ELEMENTS``), from labelled pages.

    A tag's weight is the log of how much more often it opens outside articles than inside. A feature's weight is the log of how
    much more often an element with it is part of an article, or holds it, than it is the root of something else. An element
    with classes, ids or roles speaks for these, one without for its tag; so it is for the tags' weights.
    """
    inside, outside = Counter(), Counter()
    good, bad = Counter(), Counter()
    for page in pages:
        found = [(name, own, len(features(name, value)) == 1) for kind, name, value, own, _, _ in walk(page) if kind == "open"]
        if any(own for _, own, _ in found):
            for name, own, bare in found:
                if bare:
                    (inside if own else outside)[name] += 1
        for count, elements in zip((good, bad), _labelled_elements(page)):
            for name, attrs in elements:
                own = features(name, attrs)
                count.update(own[1:] or own)
    tags_in, tags_out = sum(inside.values()), sum(outside.values())
    odds = lambda k: math.log((outside[k] + 1) / (tags_out + 10)) - math.log((inside[k] + 1) / (tags_in + 10))
    learned = {k: math.log((good[k] + 1) / (bad[k] + 1)) for k in {*good, *bad}}
    return {k: -min(4.0, max(0.05, odds(k))) for k in {*inside, *outside}} | {"": 1.0, ELEMENTS: learned}


#: Weight of a tag that no labelled page has, of one inside a marked article; share of its weight that an element left out
#: costs, as articles hold adverts too.
UNSEEN, INSIDE, LEFT_OUT = -0.5, -0.05, 0.01


def best_region(gaps: list[float], scores: list[float]) -> tuple[int, int]:
    """First and last (exclusive) of the blocks with the largest sum of their scores and of the gaps between them; (0, 0) if none
    is above zero. Of equal sums the region that ends first, and of those the shortest."""
    best = total = 0.0
    start = first = last = 0
    for k, value in enumerate(scores):
        total += gaps[k]
        if total <= 0:
            total, start = 0.0, k
        total += value
        if total > best:
            best, first, last = total, start, k + 1
    return first, last


def main_text(page: str | None, weights: dict, judge: Judge | None = None) -> str:
    """The text of the best region: blocks in page order, one per line, white space inside a block as one space.

    An element that labelled pages show to be boilerplate is a negative run: its words are left out, and it stands between blocks
    as one tag. Empty for null, for pages without words, and where nothing but boilerplate is found.
    """
    judge = judge or Judge(weights.get(ELEMENTS, {}))
    blocks: list[list[str]] = [[]]
    scores: list[float] = [0.0]  # of each block: its words and the tags in it
    gaps: list[float] = [0.0]  # of the tags before each block
    for kind, name, value, inside, bad, _ in walk(page or "", judge):
        if kind == "text":
            if not bad:
                blocks[-1].append(html_lib.unescape(value))
            elif blocks[-1]:
                blocks.append([])
                scores.append(0.0)
                gaps.append(0.0)
            continue
        weight = bad * LEFT_OUT if bad else INSIDE if inside else weights.get(name, UNSEEN)
        if name in _BLOCK and blocks[-1]:
            blocks.append([])
            scores.append(0.0)
            gaps.append(weight)
        elif name in _BLOCK or not blocks[-1]:
            gaps[-1] += weight
        else:
            scores[-1] += weight
        if name in ("br", "wbr") and blocks[-1] and kind == "open" and not bad:
            blocks[-1].append(" " if name == "br" else "")
    texts = [" ".join("".join(b).split()) for b in blocks]
    first, last = best_region(gaps, [s + weights[""] * (t.count(" ") + 1 if t else 0) for s, t in zip(scores, texts)])
    return "\n".join(t for t in texts[first:last] if t)


def labelled_sample(pages: DataFrame, most: int) -> list[str]:
    """At most ``most`` pages that mark an article, those first by a hash of id and url."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b|articlebody|\brole\s*=\s*[\"']?\s*main\b"))
    n = marked.count()
    return [r.html for r in marked.where(unit_hash("page_id", "url") < F.lit(2.0 * most / max(1, n))).orderBy(unit_hash("page_id", "url"), "page_id", "url", "html").limit(most).collect()]


def extract_main_text(pages: DataFrame, training_pages: int = 400) -> DataFrame:
    """page_id, url, text of every page; weights are fitted on about ``training_pages`` pages that mark their article.

    Null and empty pages have empty text; a null id or url stays null; repeated rows are kept; an empty table gives no rows;
    extra columns are ignored. Without any labelled page every tag has the weight ``UNSEEN``.
    """
    weights = fit_weights(labelled_sample(pages, training_pages))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(weights[ELEMENTS])
        for batch in batches:
            texts = pa.array([main_text(p, weights, judge) for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(extract, "page_id long, url string, text string")
