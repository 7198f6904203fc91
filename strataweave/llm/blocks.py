"""Main text of web pages: flat text blocks, classified by a decision tree on word counts, link densities and containers.

A page becomes a flat list of blocks (text between block-level tags).  A block's features are its words and link
density, those of its neighbours, and what encloses it: whether an article or main element does, how many elements do
that by tag or by a word in class, id or role are for something else, and which share of the page's words the outermost
of these holds.

The densest part is found from the root down, by going on to the child that holds most of the page's words outside links
(nearly all of them, if the child is by tag or name for something else and the page's title isn't in it).  The elements on
this way hold the article whatever they are called, so neither their tags nor their names count.

Nothing of that decides alone: the tree is grown, when first needed, on a table of blocks labelled in
small pages that `sample_page` lays out by rule, with named and nameless menus, adverts, notices, side bars, comments and
footers, with articles whose own class words mislead, and with pages wrapped in a form.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks

# Fixed values of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select option button".split())
TO_THE_END = frozenset("script style".split())  # without an end tag they take the rest of the page
NEVER_NESTED = frozenset("select button".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr p li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that tell what a container is for.
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr privacy notice notices alert popup modal overlay newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets rail related recommended recommendations trending share sharing social footer foot header masthead topbar copyright legal disclaimer comment comments commentlist reply replies respond discussion disqus form search searchform tags pagination pager skip toolbar complementary contentinfo".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in main part", "side tags", "side names", "share of the outermost side part", "heading")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    within: Within
    heading: bool


class Within(NamedTuple):
    """What encloses a block: a main part; the number of side tags; words that name a side part, counted inside the main
    part only if there is one; the outermost element with either (0 for none).  Elements on the way to the densest part
    have no tags and names."""

    main: bool = False
    tags: int = 0
    names: int = 0
    outermost: int = 0


class Element(NamedTuple):
    parent: int
    main: bool
    tag: bool
    named: int


#: The share of the page's words that takes the search for the densest part into a child, and into one for something else.
MOST, NEARLY_ALL = 0.5, 0.9


def surroundings(elements: list[Element], found: list[tuple[int, int, bool]]) -> list[Within]:
    """What encloses the content of each element; found has (element, words outside links, is a title) of each block."""
    held, titled = [0] * len(elements), [e.main for e in elements]
    for at, words, title in found:
        held[at] += words
        titled[at] |= title
    best = [0] * len(elements)  # the child that holds most, the first of several
    for i in range(len(elements) - 1, 0, -1):
        up = elements[i].parent
        held[up] += held[i]
        titled[up] |= titled[i]
        if not best[up] or held[i] >= held[best[up]]:
            best[up] = i
    way, at = {0}, 0
    while best[at]:
        child = best[at]
        side = elements[child].tag or elements[child].named
        if held[child] <= (NEARLY_ALL if side and not titled[child] else MOST) * held[0]:
            break
        way.add(child)
        at = child
    out = [Within()]
    for i, e in enumerate(elements[1:], 1):
        around = out[e.parent]
        tag, named = (False, 0) if i in way else (e.tag, e.named)
        if e.main and not around.main:
            out.append(Within(True, around.tags, 0, around.outermost if around.tags else 0))
        else:
            out.append(Within(around.main, around.tags + tag, around.names + named, around.outermost or (i if tag or named else 0)))
    return out


@lru_cache(maxsize=50_000)
def names(attributes: str) -> int:
    """How many words of class, id and role name a part that isn't the article; a hidden element has one."""
    values = (next(x for x in match.groups() if x is not None) for match in NAMES.finditer(attributes))
    return sum(x.lower() in BOILER_NAMES for value in values for x in PART.findall(value)) + bool(HIDDEN.search(attributes))


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order.  Unclosed tags, unknown tags and a page cut anywhere are read as far as they go."""
    found: list[tuple[str, int, int, int, str]] = []
    pieces: list[tuple[str, bool]] = []
    elements = [Element(0, False, False, 0)]
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # names without a further end tag
    link, heading = False, ""
    at, n = 0, len(page)

    def close() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join(html.unescape("".join(x for x, _ in pieces)).split())
            if text:
                linked = sum(len(html.unescape(x).split()) for x, a in pieces if a)
                found.append((text, text.count(" ") + 1, linked, stack[-1][1], heading))
            pieces = []

    def after(name: str) -> int:
        """Where an element that isn't read ends; one without an end tag is only its start tag, an option its text."""
        if name == "option":
            end = page.find("<", at)
            return n if end < 0 else end
        if name not in endless:
            again = rf"|<{name}(?=[\s>])" if name in NEVER_NESTED else ""
            end = re.compile(rf"</{name}\s*>{again}", re.I).search(page, at)
            if end:
                return end.end() if end[0][1] == "/" else at
            endless.add(name)
        return n if name in TO_THE_END else at

    while at < n:
        match = TOKEN.search(page, at)
        if match is None:
            pieces.append((page[at:], link))
            break
        if match.start() > at:
            pieces.append((page[at : match.start()], link))
        at = match.end()
        name = match[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(match[1])
        if name in RAW:
            if not closing and not match[0].endswith("/>"):
                at = after(name)
            continue
        if name == "a":
            link = not closing
        if name in INLINE:
            if name == "br":
                pieces.append((" ", link))
            continue
        close()
        link = False
        if name in HEADINGS:
            heading = "" if closing else name
        if name in VOID:
            if name != "p":
                heading = ""
            continue
        if closing:
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
        elif not match[0].endswith("/>"):
            main = name in MAIN
            elements.append(Element(stack[-1][1], main, name in ASIDE or name == "header" and not any(opened[x] for x in MAIN), 0 if main or name in ("html", "body") else names(match[3])))
            stack.append((name, len(elements) - 1))
            opened[name] += 1
    close()
    within = surroundings(elements, [(place, words - linked, title == "h1") for _, words, linked, place, title in found])
    return [Block(text, words, linked, within[place], bool(title)) for text, words, linked, place, title in found]


def features(found: list[Block]) -> np.ndarray:
    """A row for each block; beyond either end stands a block without words."""
    out = np.zeros((len(found), len(FEATURES)))
    if found:
        words = np.array([b.words for b in found], dtype=float)
        density = np.array([b.linked for b in found]) / words
        out[:, 0], out[:, 1] = words, density
        out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
        out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
        held: Counter[int] = Counter()
        for b in found:
            held[b.within.outermost] += b.words
        out[:, 6:9] = [(b.within.main, b.within.tags, b.within.names) for b in found]
        # a side part's share may be next to nothing on a long page, which isn't the same as none
        out[:, 9] = [held[b.within.outermost] / words.sum() if b.within.outermost else -1 for b in found]
        out[:, 10] = [b.heading for b in found]
    return out


def sample_page(r: random.Random) -> str:
    """A small page by rule; a block that begins with + is main text, one that begins with - is not."""

    def say(mark: str, low: int, high: int) -> str:
        n = r.randint(low, high)
        return mark + " ".join(f"w{r.randrange(900)}" for _ in range(n)) + r.choice(".  !")

    def one(*choices: str) -> str:
        return r.choice(choices)

    def box(tags: tuple[str, ...], inside: str) -> str:
        tag = r.choice(tags)
        return f"<{tag}>{inside}</{tag.split()[0]}>"

    def links(low: int = 3, high: int = 8) -> str:
        each = [f"<a href=/{i}>{say('-', 1, 5)}</a>" for i in range(r.randint(low, high))]
        return one("<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>", "<p>-" + " | ".join(each) + "</p>", "".join(f"<div>{x}</div>" for x in each))

    def advert() -> str:
        return box(("div class=ad", "div class=promo-box", "div id=sponsored", "aside", "div class='banner top'"), f"<p>{say('-', 4, 25)}" + one("", " <a href=/buy>now</a>") + "</p>")

    def notice() -> str:
        return box(("div class=cookie-notice", "div role=alert class=alert", "div id=gdpr"), f"<p>{say('-', 6, 30)}</p>" + one("", "<a href=/ok>-Ok</a>"))

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.15:
            return f"<p>{say('+', 1, 5)}</p>"
        if kind < 0.25:
            return f"<h2>{say('+', 1, 7)}</h2>"
        if kind < 0.33:
            return "<ul>" + "".join(f"<li>{say('+', 1, 9)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.40:
            return f"<p>{say('+', 1, 4)} <a href=/x>{say('', 1, 6)}</a></p>"
        if kind < 0.43:
            return f"<p><a href=/x>{say('+', 2, 7)}</a></p>"
        if kind < 0.50:
            return f"<blockquote>{say('+', 5, 30)}</blockquote>"
        return f"<p>{say('+', 10, 120)}</p>"

    def comments() -> str:
        return box(("div id=comments", "section class=comment-list", "div class='comments replies'"), one("", "<h3>-Comments</h3>") + "".join(f"<p>{say('-', 1, 40)}</p>" for _ in range(r.randint(1, 5))))

    def inset() -> str:
        return one(advert(), box(("div class=newsletter-signup", "div class=share-bar", "aside", "div class=related", "form"), one(f"<p>{say('-', 4, 20)}</p>", links(2, 5))), f"<ul>{''.join(f'<li><a href=/{i}>{say(chr(45), 2, 7)}</a></li>' for i in range(r.randint(3, 6)))}</ul>")

    semantic = r.random() < 0.75
    body = [f"<h1>{say('+', 2, 12)}</h1>"] + [paragraph() for _ in range(r.randint(1, 12))] + [one(f"<p>{say('+', 12, 90)}</p>", f"<p>{say('+', 12, 90)}</p>", f"<p>{say('+', 1, 9)}</p>")]
    if r.random() < 0.1:  # a page with hardly any article
        body = [body[0], f"<p>{say('+', 2, 25)}</p>", paragraph()][: r.randint(2, 3)]
    for _ in range(r.choice((0, 0, 0, 1, 1, 2)) if len(body) > 3 else 0):
        body.insert(r.randint(2, len(body) - 1), inset())
    ends = [comments()] if r.random() < 0.4 else []
    ends += [box(("footer", "div class=tags"), f"<p>{say('-', 2, 8)}</p>")] if semantic and r.random() < 0.3 else []
    if semantic:
        article = box(("article", "main", "article class='post share-enabled'", "main id=content", "article class='entry comments-open related-on'", "article class='post notice legal'"), "".join(body + (ends if r.random() < 0.5 else [])))
    else:
        article = box(("div", "div class=content", "div id=story", "div class='post share-enabled'", "td", "div class='post tag-comments tags'", "section class='privacy legal'"), "".join(body))
    side = box(("aside", "div class=sidebar", "div id=rail"), f"<h3>{say('-', 1, 3)}</h3>" + one(f"<p>{say('-', 10, 60)}</p>", links())) if r.random() < 0.4 else ""
    top = [box(("nav", "div class=menu", "div", "header", "table"), links())]
    top += [box(("header", "div class=masthead"), f"<p>{say('-', 2, 9)}</p>")] if r.random() < 0.3 else []
    top += [advert()] if r.random() < 0.5 else []
    top += [notice()] if r.random() < 0.25 else []
    bottom = [side, *(ends if article.count("+") and not any(x in article for x in ends) else [])]
    bottom += [box(("form", "div class=search"), f"<label>-Find</label><p>{say('-', 3, 15)}</p>")] if r.random() < 0.2 else []
    bottom += [links()] if r.random() < 0.3 else []
    bottom += [box(("footer", "footer", "div class=footer", "div class=copyright"), f"{say('-', 2, 25)}" + one("", f" <a href=/i>{say('', 1, 2)}</a>"))] if r.random() < 0.8 else []
    if r.random() < 0.3:
        top, bottom = [*top, side], bottom[1:]
    lone = lambda: box(("div", "p", "span", "td"), f"<a href=/>{say('-', 1, 3)}</a>")
    top += [lone()] if r.random() < 0.25 else []
    bottom += [lone()] if r.random() < 0.25 else []
    bottom += [box(("p", "div", "td", "font"), f"{say('-', 2, 9)} <a href=/i>{say('', 1, 2)}</a>")] if r.random() < 0.15 else []
    if r.random() < 0.1:  # cut behind the article
        bottom = []
    page = "".join(top) + article + "".join(bottom)
    return one("{}", "{}", "<div class='page has-sidebar'>{}</div>", "<form id=page>{}</form>", "<body class='single comments-open'>{}</body>").format(page)


#: Pages of the labelled table: about 6,200 blocks.
PAGES = 300


class Node(NamedTuple):
    feature: int
    at_most: float
    low: Node | None
    high: Node | None
    keep: float


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, leaf: int = 6) -> Node:
    """A binary tree by Gini impurity; a leaf has leaf rows at least; ties take the first feature and the lowest threshold."""
    share, n = float(y.mean()), len(y)
    best = (share * (1 - share) * n - 1e-9, -1, 0.0)
    if depth and 0 < share < 1:
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            value, below = x[order, j], np.cumsum(y[order])[:-1]
            low = np.arange(1, n)
            p, q = below / low, (below[-1] + y[order[-1]] - below) / (n - low)
            impurity = p * (1 - p) * low + q * (1 - q) * (n - low)
            impurity[(value[1:] == value[:-1]) | (low < leaf) | (n - low < leaf)] = np.inf
            at = int(np.argmin(impurity)) if n > 1 else 0
            if n > 1 and impurity[at] < best[0] - 1e-9:
                best = (impurity[at], j, float(value[at] + value[at + 1]) / 2)
    if best[1] < 0:
        return Node(-1, 0.0, None, None, share)
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf), share)


def predict(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.low is None or tree.high is None:
        return np.full(len(x), tree.keep >= 0.5)
    low = x[:, tree.feature] <= tree.at_most
    out = np.empty(len(x), dtype=bool)
    out[low], out[~low] = predict(tree.low, x[low]), predict(tree.high, x[~low])
    return out


def labelled_table(pages: int = PAGES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of so many sample pages."""
    rows, labels, r = [], [], random.Random(seed)
    for _ in range(pages):
        found = blocks(sample_page(r))
        rows.append(features(found))
        labels += [b.text.startswith("+") for b in found]
    return np.concatenate(rows), np.array(labels, dtype=float)


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(*labelled_table())


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, predict(tree(), features(found)), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page.

    Null or empty html gives an empty text, null ids and urls stay null, repeated rows repeat, and an empty table gives
    none.  A long page is read whole, as one row of its own chunk.  Other columns of pages, whatever their names, are
    left out.  Ties don't arise: each page is judged by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
