"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tokens, words and tags. Words score positive, unless they stand in a link or outside what
the page marks as its article; tags score negative. The contiguous region with the highest sum is the main content: a
linear scan finds it. Menus, headers, footers, sidebars, notices, adverts, forms, comments and hidden elements, known by
their element, role, class or id, are left out wherever they stand: their words score nothing and are not part of the text.

Weights come from labelled pages: those that mark their article (`<article>`, `<main>`, role main, itemprop
articleBody), all of them, in one pass. For each kind of token the pass counts how often it lies inside and outside the
marked article. A word's weight is the logarithm of its odds to lie inside, a tag's that of its share inside; both are
smoothed by PRIOR counts and cut at LIMIT. Kinds of words are linked, in a heading, or plain, in blocks of fewer than SHORT words or not
(the words left out count as outside there, so menus and adverts teach what such words look like), and on pages with
marks inside or outside of them. Without any labelled page the priors alone decide.

Text: character references are decoded; white space inside a block is one space; blocks are trimmed and joined by one
space in page order; `<br>` is white space. Comments, scripts, styles and other unseen elements have no text.

Defined cases: null, empty and all-markup pages have an empty text; a tag or comment that is never closed ends the
page, as in browsers, and a `<` that starts no tag is text; end tags that match nothing are ignored; of regions with
equal sums the first stands, without its unscoring ends; repeated rows and null ids are pages each; an empty table gives
an empty result; extra columns are ignored. Pages are read whole, however long, in time linear in their length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts

LIMIT = {"word": 3.0, "tag": 2.0}
#: What a word that is not linked scores at least, on a page without marks.
LEAST = 0.1
SHORT = 10
#: Counts (inside, outside) that each kind has before any page is read.
PRIOR = {"word": (20.0, 2.0), "word short": (15.0, 10.0), "word heading": (20.0, 4.0), "word link": (2.0, 20.0), "word short link": (1.0, 20.0), "word in": (20.0, 1.0), "word in link": (20.0, 1.0), "word out": (1.0, 20.0), "word out link": (1.0, 20.0), "tag": (10.0, 10.0)} | {f"tag {name}": (20.0, 1.0) for name in ("p", "blockquote", "b", "em", "i", "strong")}

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video map select option button textarea input dialog form nav aside footer menu".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element closes an open one of these of its own kind, or of the same set, up to the given borders.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id that name what is no article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox banner banners sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended share sharing social comment comments commentlist respond disqus reply replies discussion footer masthead pagination pager login search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no class or id hides, as it speaks of the page's layout.
KEPT = frozenset("html body article main".split())

_ATTRIBUTES = r"""((?:[^>"']++|"[^"]{0,4096}+"|'[^']{0,4096}+')*+)>"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+){_ATTRIBUTES}")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page's tags and texts in order; kind is `start`, `end` or `text`."""
    at, size, closing = 0, len(page), page.rfind(">")
    while at < size:
        less = page.find("<", at)
        text_end = less if less >= 0 else size
        if text_end > at:
            yield "text", page[at:text_end], ""
        if less < 0:
            return
        at = less
        after = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)  # <!--> is a whole comment
            if end < 0:
                return
            at = end + 3
        elif after in ("!", "?") or after == "/" and not page[at + 2 : at + 3].isalpha():
            end = page.find(">", at)
            if end < 0:
                return
            at = end + 1
        elif after == "/" or (after.isascii() and after.isalpha()):
            if at > closing:
                return
            found = _TAG.match(page, at)
            if found:
                slash, name, attributes = found.groups()
                at = found.end()
            else:  # a quote that is not closed
                named = _NAME.match(page, at)
                end = page.find(">", at)
                if not named:
                    at = end + 1
                    continue
                slash, name = named.groups()
                attributes, at = page[named.end() : end], end + 1
            name = name.lower()
            yield ("end" if slash else "start"), name, attributes
            if not slash and name in RAW:
                closed = _END[name].search(page, at)
                at = closed.start() if closed else size
        else:
            yield "text", "<", ""
            at += 1


def attributes_of(raw: str) -> dict[str, str]:
    return {name.lower(): html.unescape(a or b or c or "") for name, a, b, c in _ATTRIBUTE.findall(raw)} if "=" in raw or raw.strip(" /") else {}


def hinted(attributes: dict[str, str]) -> bool:
    """Whether class or id name what is no article, or the element is hidden."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return any(word.lower() in HINTS for word in _HINT.findall(names))


def marks(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop", "").lower() == "articlebody"


class Page:
    """A page's scored tokens, (kind, words, place of its text or -1, inside a marked article), and its texts (block, text); `left` counts the words left out."""

    def __init__(self, page: str):
        self.tokens: list[tuple[str, int, int, bool]] = []
        self.left: Counter[str] = Counter()
        self.texts: list[tuple[int, str]] = []
        #: name, unseen, marked, kind of words; the states hold for all that is inside.
        stack: list[tuple[str, bool, bool, str]] = [("", False, False, "")]
        open_: Counter[str] = Counter()
        in_block: Counter[int] = Counter()
        block = 0

        def close(name: str) -> None:
            while len(stack) > 1:
                was = stack.pop()[0]
                open_[was] -= 1
                if was == name:
                    return

        def close_sibling(names: Iterable[str], borders: Iterable[str]) -> None:
            if not any(open_[n] for n in names):
                return
            for name, *_ in reversed(stack):
                if name in borders:
                    return
                if name in names:
                    return close(name)

        for kind, name, raw in tokens(page):
            if kind == "text":
                inner, unseen, marked, state = stack[-1]
                if inner in RAW:
                    continue
                text = html.unescape(name)
                words = len(text.split())
                if unseen:
                    self.left[f"word short{state}" if state != " heading" else "word heading"] += words
                    continue
                self.tokens.append((state, words, len(self.texts), marked))
                self.texts.append((block, text))
                in_block[block] += words
                continue
            if name == "br":
                self.texts.append((block, " "))
                continue
            if name not in INLINE:
                block += 1
            if kind == "end":
                _, unseen, marked, _ = stack[-1]
                if open_[name]:
                    close(name)
                    unseen, marked = unseen or stack[-1][1], marked or stack[-1][2]
                if not unseen:
                    self.tokens.append((f"tag {name}", 0, -1, marked))
                continue
            if name in CLOSES_P and open_["p"]:
                close_sibling(("p",), ("button", "table", "td", "th"))
            if name in SIBLINGS:
                close_sibling(*SIBLINGS[name])
            _, unseen, marked, state = stack[-1]
            attributes = attributes_of(raw)
            article = marks(name, attributes)
            outside = name == "header" and not marked
            gone = name in UNSEEN or outside or attributes.get("role") in ROLES or name not in KEPT and hinted(attributes) or article and marked and hinted(attributes)
            unseen, marked = unseen or gone, marked or article
            if not unseen:
                self.tokens.append((f"tag {name}", 0, -1, marked))
            if name not in VOID and not raw.endswith("/") or name in RAW:
                stack.append((name, unseen, marked, " link" if name == "a" else state or (" heading" if name in HEADINGS else "")))
                open_[name] += 1
        short = lambda kind, place: " short" if kind != " heading" and in_block[self.texts[place][0]] < SHORT else ""
        self.tokens = [(f"word{short(kind, place)}{kind}" if place >= 0 else kind, n, place, inside) for kind, n, place, inside in self.tokens]
        self.marked = any(inside for *_, inside in self.tokens)

    def kinds(self) -> Iterator[tuple[str, int, int]]:
        """(kind, times, place) of each token: on a page with marks, words say whether they are inside."""
        for kind, words, place, inside in self.tokens:
            if place >= 0 and self.marked:
                kind = f"word {'in' if inside else 'out'}{' link' if kind.endswith('link') else ''}"
            yield kind, words if place >= 0 else 1, place

    def text(self, weights: dict[str, float]) -> str:
        """The text of the best region."""
        first, last = best_region([(times * weight_of(kind, weights), place) for kind, times, place in self.kinds()])
        blocks: list[list[str]] = []
        at = None
        for block, text in self.texts[first:last]:
            if block != at:
                blocks.append([])
                at = block
            blocks[-1].append(text)
        return " ".join(t for t in (" ".join("".join(parts).split()) for parts in blocks) if t)


def best_region(scored: list[tuple[float, int]]) -> tuple[int, int]:
    """From the first to past the last place of the contiguous region with the highest positive sum, by a linear scan.

    Tokens are (score, place), place -1 for those without; it starts and ends at a token that scores positive.
    """
    best, found, total, start = 0.0, (0, 0), 0.0, -1
    for score, place in scored:
        if start < 0 or total <= 0:
            if score <= 0 or place < 0:
                continue
            total, start = 0.0, place
        total += score
        if total > best and place >= 0 and score > 0:
            best, found = total, (start, place + 1)
    return found


def weight_of(kind: str, weights: dict[str, float]) -> float:
    found = weights.get(kind)
    return found if found is not None else _weight(kind, 0, 0)


def _weight(kind: str, inside: float, outside: float) -> float:
    family = kind.partition(" ")[0]
    more, less = PRIOR.get(kind) or PRIOR[family]
    inside, outside, limit = inside + more, outside + less, LIMIT[family]
    score = math.log(inside / outside) if family == "word" else math.log(inside / (inside + outside))
    return max(LEAST if kind in ("word", "word short", "word heading") else -limit, min(limit, score))


def _counts(page: str) -> Counter[tuple[str, bool]]:
    """(kind, inside): times, of a page with marks; its words count by both kinds that they have."""
    read, out = Page(page), Counter()
    if read.marked:
        for (kind, words, place, inside), (own, times, _) in zip(read.tokens, read.kinds(), strict=True):
            out[own, inside] += times
            if place >= 0:
                out[kind, inside] += words
        for kind, words in read.left.items():
            out[kind, False] += words
    return out


def fit(pages: DataFrame, known: int = 10_000) -> dict[str, float]:
    """The weight of each kind of token, from all pages that mark their article. Only elements of `known` such pages' kinds count, the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for page in texts(batch.column(0)):
                total.update(_counts(page.decode("utf-8", "replace")))
            if len(total) > known:  # invented elements
                yield of(total)
                total.clear()
        yield of(total)

    def of(total: Counter) -> pa.RecordBatch:
        kinds, n = [k for k, _ in total], list(total.values())
        inside = [v if i else 0 for (_, i), v in total.items()]
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(inside, pa.int64()), pa.array([a - b for a, b in zip(n, inside, strict=True)], pa.int64())], ["kind", "inside", "outside"])

    sums = pages.select("html").mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    top = sums.orderBy((F.col("inside") + F.col("outside")).desc(), "kind").limit(known).collect()  # elements may be invented: no more than so many weights
    return {r["kind"]: _weight(r["kind"], r["inside"], r["outside"]) for r in top}


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    weights = fit(pages)
    rows = pages.select("page_id", "url", "html")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(page.decode("utf-8", "replace")).text(weights) for page in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
