"""Operator 8, HTML extraction by the maximum-scoring subsequence of words and tags.

A page is a sequence of tags and text runs. Tags score below zero; words score by the elements that
they stand in, above zero where labelled pages have article words there. A linear scan finds the
contiguous run of highest sum (of equal sums, the first); its text runs that score above zero are the article.

The weights are log odds of the words inside and outside of articles, by element name, and by element name with class, id or role token. They are fitted on
labelled pages, those that mark their article with ``article`` or ``main``; ``fit`` reads about ``sample_pages`` (default 5,000, chosen by a hash of the
id) of them. Names that usually mean a menu, header, footer, sidebar, notice, advert, form or comments count as PRIOR_WORDS words outside from the start, names
such as content as as many inside, and labelled pages add to that. As marked articles hold such furniture too, its words count as outside there. An element whose
own names have odds of e to 1 or more against the article is furniture:

* never ``html`` or ``body``; ``article`` and ``main`` only where their class says so and others stand beside them;
* not if it holds most of the words of the page's articles, such as a form around the page;
* without any article on the page, not if nearly all words that are in no furniture would be gone (links, footers, asides and comments excepted).

Words in furniture score -1 each, but the part scores 0 where it stands inside an element that has article words before it or is itself of the article: an
aside doesn't cut an article in two. Other words score 0.5 more than the sum of the weights around them, each clipped, from -1 to 1; in an article always above zero,
outside of it, if the page's articles have a fifth of its words, below. A page without any word above zero is scored anew without furniture but for the elements themselves, then without any.

The time is linear in the page, however its elements nest.

Edge cases: null html is the empty page, whose text is empty. Pages cut off in a tag or without end
tags (``</head>`` among them) are read to their end. A page without article words has the empty text. Very long pages
are read whole. Repeated rows and rows without id are extracted one by one, extra columns are ignored, an empty table gives none.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 5000
#: Elements around a word that fitting looks at, from the innermost on; scoring sums all.
DEPTH = 64
#: Elements whose content is never text (fixed values).
SILENT = frozenset("script style noscript template head title svg math iframe object select option textarea button datalist canvas audio video".split())
#: Elements that are page furniture unless labelled pages say otherwise (fixed values).
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
#: Furniture that goes whatever its share of the page (fixed values).
SURE = frozenset("nav footer aside menu dialog".split())
COMMENTS = frozenset("comment comments reply replies".split())
#: Class, id and role names of furniture and of content, and words that say nothing beside them (fixed values).
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts banner promo "
    "sponsored cookie cookies consent notice notices popup modal newsletter subscribe share sharing social related breadcrumb "
    "breadcrumbs comment comments reply replies pagination form login search searchform widget toolbar copyright disclaimer "
    "contentinfo complementary".split()
)
CONTENT_NAMES = frozenset("content article post entry story main text body prose page".split())
NEUTRAL = frozenset("left right top bottom wrapper wrap container box block list item items links link inner outer area section bar panel primary secondary site main page global".split())
MODIFIERS = frozenset("has no with without not is hide show toggle article post entry story content".split())
#: Wrappers around each other that may be furniture by name and still hold the page.
NESTED = 8
#: Words that a name counts as before any labelled page is seen.
PRIOR_WORDS = 50
#: Elements inside a line of text (fixed values); every other element begins and ends a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr input".split()
)
#: Elements that a head may hold (fixed values); any other one ends it.
HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"\S+")


@functools.lru_cache(maxsize=65_536)
def prior(feature: str) -> tuple[float, float]:
    """Words inside and outside of articles that a name counts as from the start.

    A name of several parts is told by its last part that says something: a cookie-notice is a notice, a share-price is not. After has, no and
    the like, or the name of an article, a furniture word says nothing of the element.
    """
    name, _, token = feature.partition(".")
    if not token:
        return (0.5, 0.5 + PRIOR_WORDS) if name in FURNITURE else (0.5 + PRIOR_WORDS, 0.5) if name in ("article", "main") else (0.5, 0.5)
    parts = [x for x in re.split(r"[._-]+", token) if x]
    while len(parts) > 1 and parts[-1] in NEUTRAL | {""}:
        parts.pop()
    if not parts or (parts[-1] not in COMMENTS and MODIFIERS & set(parts[:-1])):
        return 0.5, 0.5
    if parts[-1] in FURNITURE_NAMES:
        return 0.5, 0.5 + PRIOR_WORDS
    return (0.5 + PRIOR_WORDS, 0.5) if parts[-1] in CONTENT_NAMES else (0.5, 0.5)


def odds(inside: float, outside: float, feature: str) -> float:
    a, b = prior(feature)
    return math.log((inside + a) / (outside + b))


def weight_of(weights: dict[str, float], feature: str) -> float:
    known = weights.get(feature)
    return odds(0, 0, feature) if known is None else known


class Element:
    """An element of a page, and what ``judge`` finds out about it."""

    __slots__ = ("name", "features", "parent", "block", "silent", "marked", "total", "held", "furniture", "outer", "article", "soft", "words")

    def __init__(self, name: str, features: list[str], parent: Element | None):
        self.name, self.features, self.parent = name, features, parent
        self.block = self if name not in INLINE or parent is None else parent.block  # the nearest one that is not inline
        self.silent = name in SILENT or (parent is not None and parent.silent)
        self.marked = name in ("article", "main")
        self.total = 0  # visible words in it
        self.held = 0  # words in the articles in it
        self.furniture = self.article = self.words = False
        self.outer: Element | None = None
        self.soft = 0.0


_TOP = ("html", "body")


def parse(page: str) -> tuple[list[tuple[str, str, Element | None]], list[Element]]:
    """(kind, value, innermost open element) for each tag and text run of a page, and its elements in order.

    kind is "tag" (value: name), "block" (a tag that ends a block) or "text" (value: raw text).
    """
    events: list[tuple[str, str, Element | None]] = []
    elements: list[Element] = []
    top: Element | None = None
    open_: Counter = Counter()
    at, end = 0, len(page)

    def close(name: str) -> None:
        nonlocal top
        while True:
            gone = top
            open_[gone.name] -= 1
            top = gone.parent
            if gone.name == name:
                return

    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            events.append(("text", page[at:], top))
            break
        if found.start() > at:
            events.append(("text", page[at : found.start()], top))
        at = found.end()
        closing, name, rest = found[1] or found[4], (found[2] or found[5] or "").lower(), found[3] or ""
        if not name:
            continue
        kind = "tag" if name in INLINE else "block"
        if closing:
            if open_[name]:
                close(name)
            events.append((kind, "/" + name, top))
            continue
        if open_["head"] and name not in HEAD and name != "head":
            close("head")
        if name == "p" and open_["p"] and top.block.name == "p":  # a paragraph ends the one before it
            close("p")
        features = [name]
        for m in _NAMES.finditer(rest):
            features += [f"{name}.{c.lower()}" for c in (m[1] or m[2] or m[3] or "").split()]
        if name not in VOID and not rest.endswith("/"):
            top = Element(name, features, top)
            elements.append(top)
            open_[name] += 1
        events.append((kind, name, top))
        if name in ("script", "style", "textarea", "title", "noscript"):
            stop = re.compile(f"</{name}", re.I).search(page, at)
            stop = stop.start() if stop else end
            events.append(("text", page[at:stop], top))
            at = stop
    return events, elements


def _within(e: Element, around: Element) -> bool:
    """Whether the outermost furniture ``e`` is in ``around``; looks up a bounded number of elements."""
    for _ in range(DEPTH):
        if e is None:
            return False
        if e is around:
            return True
        e = e.parent
    return False


def judge(events: list, elements: list[Element], weights: dict[str, float], names: bool = True) -> None:
    """What is furniture and what is of the article; without ``names`` only elements themselves can be furniture."""
    for kind, value, element in events:
        if kind == "text" and element is not None and not element.silent:
            element.total += len(_WORD.findall(value))
    loose = sum(len(_WORD.findall(value)) for kind, value, element in events if kind == "text" and element is None)
    for e in reversed(elements):  # children come after their parents
        if e.parent is not None:
            e.parent.total += e.total
    against: dict[int, float] = {}
    for e in elements:
        inside = e.marked or (e.parent is not None and e.parent.article)
        e.article = inside
        own = sum(max(-4.0, min(4.0, weight_of(weights, f))) for f in dict.fromkeys(e.features[1:])) if names else 0.0
        if e.name in FURNITURE and not (e.name == "header" and inside):
            own += max(-4.0, min(4.0, weight_of(weights, e.name)))
        if own <= -1.0 and e.name not in _TOP:
            against[id(e)] = own
    if all(id(e) in against for e in elements if e.marked):
        for e in elements:
            if e.marked:
                against.pop(id(e), None)
    true = {id(e) for e in elements if e.marked and id(e) not in against}
    whole = 0
    within: dict[int, bool] = {}
    for e in elements:  # words of the outermost articles
        above = e.parent is not None and within[id(e.parent)]
        within[id(e)] = above or id(e) in true
        if id(e) in true and not above:
            whole += e.total
            if e.parent is not None:
                e.parent.held += e.total
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.held += e.held
    for e in elements:
        e.furniture = id(e) in against and not (whole and 2 * e.held > whole)
        e.outer = e.parent.outer if e.parent is not None else None
        if e.outer is None and e.furniture:
            e.outer = e.parent if e.parent is not None else e
    free = loose + sum(e.total for e in elements if e.parent is None) - sum(e.total for e in elements if e.furniture and (e.parent is None or e.parent.outer is None))
    for _ in range(NESTED if not whole else 0):  # furniture that is all of the page, then what is in it
        soft = [e for e in elements if e.furniture and (e.parent is None or e.parent.outer is None) and e.name not in SURE and not any(COMMENTS & set(re.split(r"[._-]+", f)) for f in e.features[1:])]
        largest = max(soft, key=lambda e: e.total, default=None)
        if largest is None or 10 * free >= largest.total:
            break
        largest.furniture = False
        for e in elements:
            e.outer = e.parent.outer if e.parent is not None else None
            if e.outer is None and e.furniture:
                e.outer = e.parent if e.parent is not None else e
        free += largest.total - sum(e.total for e in elements if e.furniture and e.parent is not None and e.parent.outer is None and _within(e, largest))
    trusted = 5 * whole >= free > 0
    for e in elements:
        e.article = id(e) in true or (e.parent is not None and e.parent.article)
        own = 0.0
        if e.name not in _TOP and not e.furniture:
            own = max(-0.2, min(0.2, weight_of(weights, e.name))) if not e.marked else 0.5
            own += sum(max(-0.5, min(0.5, weight_of(weights, f))) for f in dict.fromkeys(e.features[1:])) if names else 0.0
        e.soft = own + (e.parent.soft if e.parent is not None else (-1.5 if trusted else 0.0))


def label_counts(page: str) -> tuple[Counter, Counter]:
    """Of a labelled page: words (and tags, named <tag) inside and outside its article, by feature."""
    events, elements = parse(page)
    judge(events, elements, {})
    inside, outside, words, below = Counter(), Counter(), Counter(), {}
    for kind, value, element in events:
        side = inside if element is not None and element.article and element.outer is None else outside
        if kind == "text":
            if element is not None and not element.silent and (n := len(_WORD.findall(value))):
                words[id(element)] += n
                below[id(element)] = element
        elif not value.startswith("/"):
            side["<" + value] += 1
    for key, element in below.items():
        side = inside if element.article and element.outer is None else outside
        seen, at = set(), element
        for _ in range(DEPTH):
            if at is not None:
                seen.update(at.features)
                at = at.parent
        for f in seen:
            side[f] += words[key]
    return inside, outside


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from about ``sample_pages`` labelled pages, by grouped sums."""
    import pyarrow as pa

    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    share = min(1.0, sample_pages / max(1, pages.count()))
    sample = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < round(share * 1_000_000)).select("html")

    def counted(batches):
        for batch in batches:
            inside, outside = Counter(), Counter()
            for page in batch.column(0).to_pylist():
                a, b = label_counts(page or "")
                inside.update(a)
                outside.update(b)
            names = list(inside | outside)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())],
                ["feature", "inside", "outside"],
            )

    sums = sample.mapInArrow(counted, "feature string, inside long, outside long").groupBy("feature")
    # No more features than the sampled pages hold.
    return {r.feature: odds(r.i, r.o, r.feature) for r in sums.agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()}


def scores(page: str, weights: dict[str, float], names: bool = True, tags: bool = True) -> list[tuple[float, str | None]]:
    """The score of each tag and text run, and its text (None where a block ends); ``names`` and ``tags`` tell what can be furniture."""
    events, elements = parse(page)
    judge(events, elements, weights, names)
    scored: list[tuple[float, str | None]] = []
    for kind, value, element in events:
        if kind != "text":
            name = value.lstrip("/")
            scored.append((max(-1.0, min(-0.02, 0.1 * weights.get("<" + name, -1.0))), None if kind == "block" else (" " if name == "br" else "")))
            continue
        if not value.strip():
            scored.append((0.0, " "))
            continue
        if element is not None and element.silent:
            continue
        words = len(_WORD.findall(value))
        if tags and element is not None and element.outer is not None:
            around = element.outer
            joins = around.article or around.words
            scored.append((0.0 if joins and around.name not in _TOP else -float(words), ""))
            continue
        if element is None:
            each = 0.5
        elif element.article:
            each = max(0.3, min(1.0, 2.0 + element.soft))
        else:
            each = max(-1.0, min(1.0, 0.5 + element.soft)) if tags else 0.5
        if each > 0:
            at = element
            while at is not None and not at.words:
                at.words, at = True, at.parent
        scored.append((each * words, value if each > 0 else ""))
    return scored


def best_region(values: list[float]) -> tuple[int, int]:
    """From and to of the contiguous run of highest sum, the first of equal ones; (0, 0) if none is above zero."""
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for k, score in enumerate(values):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, best_from, best_to = total, start, k + 1
    return best_from, best_to


def article(page: str, weights: dict[str, float]) -> str:
    """The text of one page's best-scoring region."""
    for own, names, tags in ((weights, True, True), ({}, False, True), ({}, False, False)):  # the latter for pages unlike all others
        scored = scores(page, own, names, tags)
        low, high = best_region([x for x, _ in scored])
        if low < high:
            break
    blocks, line = [], []
    for _, value in [*scored[low:high], (0.0, None)]:
        if value is None:
            if text := " ".join(entities.unescape("".join(line)).split()):
                blocks.append(text)
            line = []
        else:
            line.append(value)
    return "\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; weights are fitted on ``pages`` unless given."""
    import pyarrow as pa

    weights = fit(pages) if weights is None else weights

    def extracted(batches):
        for batch in batches:
            texts = [article(page or "", weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(
        extracted, "page_id long, url string, text string, n_chars long"
    )
