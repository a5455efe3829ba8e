"""HTML extraction (operator 5): line-block distribution.

A page becomes lines, one for each block of its markup, without the elements that never hold an article (menus,
forms, scripts and the like, by name, role or class); a left-out element is one empty line. The weight of a line is
its text length; text of links counts little inside an article and nothing elsewhere.

* Sums of weights over a sliding window of lines give the distribution of the page's text. The threshold between
  text and the rest is fitted to the page: a share of the mean window sum, weighted by the sums themselves.
* A run of text surges at the first line whose windows (the one that ends there and the one that begins there) both
  hold more than the threshold, and it dives at the last such line. Headings just before a surge belong to the run.
* Runs are joined over what lies between them inside one container, and a run inside an ``article`` or ``main`` takes
  all lines of it, so nothing is cut at its ends. Lines outside runs and their articles are furniture.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from railbeam.llm.common import renamed

#: Lines of a window, and the share of the page's mean window sum that a line of text needs around it.
WINDOW, SHARE = 3, 0.2
#: What a character of link text weighs inside an article.
LINKED = 0.25

_TAG = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^<>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no article text.
DROPPED = frozenset("head nav aside footer form noscript template svg canvas button select option object embed audio video map menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark furniture, notices, adverts and reader comments.
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|login|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|rail|aside|footer\w*|masthead|header|"
    r"topbar|toolbar|comments?|commentlist|respond|replies|disqus|related|recommend\w*|share|sharing|social\w*|widget\w*|search|"
    r"pagination|pager|complementary|contentinfo|copyright|skip|hidden|toc)(?=$|[\s_-])",
    re.IGNORECASE,
)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body)(?=$|[\s_-])", re.IGNORECASE)
#: Whole class words that mark the same on a paragraph, heading or list inside an article, where parts of a word don't.
_STRICT = frozenset(
    "ad ads advert advertisement sponsor sponsored promo promotion banner cookie cookies consent newsletter subscribe signup login popup modal "
    "overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar comment comments disqus related share sharing social widget pagination hidden".split()
)
#: Elements that hold other blocks, so that their class says what all of them are.
CONTAINERS = frozenset("article aside center dd details dialog div dl fieldset figure li main menu nav ol section table tbody td tr ul".split())
_ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED:
        return True
    if name == "header":
        return not inside
    if name in ("html", "body", "main", "h1") or not attributes.strip():
        return False
    marks = []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                return True
        elif key in ("class", "id", "role"):
            marks.append(value)
    text = " ".join(marks)
    if not text:
        return False
    if name == "article":
        return bool(re.search(r"(?:^|[\s_-])comment", text, re.IGNORECASE))
    if inside and name not in ("div", "section"):
        return not _STRICT.isdisjoint(text.lower().split())
    return bool(_FURNITURE.search(text)) and not (_CONTENT.search(text) and name in ("section", "div"))


class Line(NamedTuple):
    """A block's text and weight; the article (0: none) and the container it lies in, by number."""

    text: str
    weight: float
    article: int = 0
    container: int = 0
    heading: bool = False


def lines(html: str) -> list[Line]:
    """The blocks of a page, with one empty line where an element was left out."""
    found: list[Line] = []
    parts: list[str] = []
    linked = numbers = 0
    heading = False
    open_ones: list[tuple[str, int]] = []  # containers around the place: (name, number)

    def innermost(names: frozenset[str]) -> int:
        return next((number for name, number in reversed(open_ones) if name in names), 0)

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                article = innermost(_ARTICLES)
                weight = len(text) - min(len(text), linked) * (1 - LINKED if article else 1)
                found.append(Line(text, weight, article, innermost(CONTAINERS), heading))
            parts.clear()
        linked = 0

    skip, depth, links, at = "", 0, 0, 0
    for m in _TAG.finditer(html):
        if not skip and m.start() > at:
            parts.append(html[at : m.start()])
            if links:
                linked += len(_SPACE.sub(" ", unescape(parts[-1])).strip())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:  # comments, declarations and raw elements show nothing
            continue
        closing = bool(m["close"])
        if skip:
            if name == skip and not m["attributes"].endswith("/"):
                depth += -1 if closing else 1
            leaves = depth == 0 or (name in ("article", "main", "body") and not closing and skip not in ("template", name)) or (closing and name in ("body", "html"))
            if not leaves:
                continue
            skip, depth = "", 0
            if closing:
                continue
        if not closing and _is_furniture(name, m["attributes"], bool(innermost(_ARTICLES))):
            end_line()
            found.append(Line("", 0, innermost(_ARTICLES), innermost(CONTAINERS)))
            if name not in VOID and not m["attributes"].endswith("/"):
                skip, depth = name, 1
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name in BLOCKS:
            end_line()
            links, heading = 0, name in HEADINGS and not closing
        elif name == "br":
            parts.append(" ")
        if name in CONTAINERS and name not in ("li", "tr", "tbody", "dd"):
            if not closing:
                numbers += 1
                open_ones.append((name, numbers))
            else:
                place = next((i for i in range(len(open_ones) - 1, -1, -1) if open_ones[i][0] == name), None)
                if place is not None:
                    del open_ones[place:]
    if not skip and at < len(html):
        parts.append(html[at:])
    end_line()
    return found


def threshold(sums: np.ndarray) -> float:
    """What a window of text holds at least: a share of the mean of the page's window sums, each weighted by itself."""
    return SHARE * float((sums * sums).sum() / sums.sum()) if sums.any() else 0.0


def runs(weights: np.ndarray) -> list[tuple[int, int]]:
    """(line of the surge, line after the dive) of each run of text."""
    if not len(weights):
        return []
    sums = np.convolve(weights, np.ones(WINDOW))  # sum k is that of the lines k - WINDOW + 1 to k
    around = np.minimum(sums[: len(weights)], sums[WINDOW - 1 :])
    # Sums of fractions are compared with some room, so that their order of addition doesn't matter.
    dense = np.concatenate(([False], (around >= threshold(sums) - 1e-6) & (around > 0), [False]))
    edges = np.nonzero(dense[1:] != dense[:-1])[0]
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def main_lines(page: list[Line]) -> list[int]:
    """The places of the article's lines: runs with their headings, joined inside containers, widened to articles."""
    found = runs(np.array([line.weight for line in page], np.float64))
    if any(page[k].article for first, stop in found for k in range(first, stop)):
        # The page names its articles: those that hold a run are the text, whole.
        named = {page[k].article for first, stop in found for k in range(first, stop) if page[k].article}
        return [k for k, line in enumerate(page) if line.article in named]
    kept = set()
    for i, (first, stop) in enumerate(found):
        while first and page[first - 1].heading:
            first -= 1
        if i:
            before = found[i - 1][1]
            shared = {page[k].container for k in range(*found[i - 1])} & {page[k].container for k in range(first, stop)} - {0}
            first = before if shared else first
        kept.update(range(first, stop))
    return sorted(kept)


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line feeds; empty if there is none."""
    page = lines(html or "")
    return "\n".join(page[k].text for k in main_lines(page) if page[k].text)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    A null page counts as empty; empty pages and pages without text outside furniture have the empty text. Null
    ids and repeated rows are extracted like any other. An empty table gives an empty result. Broken markup ends
    nothing early: an open tag, comment or entity at the end of a page is read as far as it goes.
    """
    slim = renamed(pages, page_id=page_id, url=url, html=html)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    id_type = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(of, f"page_id {id_type}, url string, text string, n_chars long")
