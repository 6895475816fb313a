"""HTML main-text extraction by tag-path ratios.

A page is tokenised into text blocks; each block knows its root-to-leaf path of tags (with class, id and role words).  Over
all blocks of a page, each path gets two ratios: text length a block and punctuation marks a block, both with text in links
counted against them.  A block carries its path's ratios; the two series are smoothed over neighbouring blocks with a Gaussian
and fused by their geometric mean.  A path's score is the text-weighted mean of the fused values of its blocks; it is content
if that reaches ``THRESHOLD`` times the text-weighted mean over the page.  Blocks of content paths are kept.  So are headings and short
paragraphs that stand among them: other blocks of the element (an article or main, else the least one) that holds most
of the content paths' text.

Elements that are no text by what they are (navigation, footers, asides, forms, scripts, styles and the like, hidden ones) do
not take part.  Class, id or role words that name menus, adverts, notices, sidebars or comments do not rule anything out: they
multiply a path's score by ``DOUBT``, and its blocks then need content ratios of their own to stay.  Such a word says nothing of
an element with more than half of the page's text: it wraps the page.

Character references are decoded (but not in scripts), white space inside a block becomes one space, blocks are joined by an
empty line in page order.  Nothing is cut or dropped for length; time is linear in the page, however deep elements nest.  Null
is the empty page; an empty page or one without content gives the empty text.  Pages are independent: no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3
DOUBT = 0.05
RADIUS = 2
SIGMA = 1.0

#: Element names and words in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
NEVER = frozenset(
    "nav header footer aside form script style noscript template iframe head title button select option textarea input label svg"
    " canvas object embed applet menu dialog fieldset legend datalist map audio video math".split()
)
CONTAINERS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu"
    " breadcrumb breadcrumbs header masthead footer foot sidebar aside widget related recommended share sharing social comment"
    " comments disqus reply replies respond cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe"
    " subscription signup login search pagination pager toolbar skip hidden byline-share tags toc copyright legal complementary"
    " contentinfo banner-ad outbrain taboola".split()
)
#: What speaks against an element: words, or what it is.
NAMED, HIDDEN = 1, 2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag may be missing: an opening tag on the left closes open ones on the right.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
SCOPES = frozenset("html body table ul ol dl div article section main td th nav aside header footer form".split())
ENDS_P = BLOCK - frozenset("dd dt li td th tr tbody thead tfoot html body option optgroup legend summary figcaption".split()) | frozenset(("p",))

#: A quote counts only at the start of an attribute's value; elsewhere it is a character like others.
VALUE = r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)"""
TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:[^>=]+|{VALUE})*)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")
MARKS = re.compile(r"[.,;:!?…。、！？]")
SPLIT = re.compile(r"[^a-z]+")


def _names(attributes: str) -> tuple[str, int]:
    """(words of class, id and role; ``NAMED`` if these speak against the element, ``HIDDEN`` if others hide it, else 0)."""
    words, bad = [], 0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            plain = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
            words.append(plain)
            bad = max(bad, NAMED * any(w in BAD_WORDS for w in SPLIT.split(plain)))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            bad = HIDDEN
    return " ".join(words), bad


class Block:
    __slots__ = ("path", "element", "text", "linked")

    def __init__(self, path: int, element: int, text: str, linked: int):
        self.path, self.element, self.text, self.linked = path, element, text, linked


class Page:
    """The non-empty text blocks of a page in order, and the elements that they stand in.

    Elements (block level, or with words or hidden) are numbered as they open, so a parent comes before its children; number 0
    is the page.  ``tag``, ``parent``, ``bad`` and ``names`` (of their paths) go by number; paths have numbers of their own."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.tag, self.parent, self.bad, self.path_of = [""], [0], [0], [0]
        self.paths: dict[tuple[int, str], int] = {}
        #: open elements: (tag, number of the element whose text theirs is, opens it)
        self.stack: list[tuple[str, int, bool]] = []
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.scopes: list[int] = []
        self.parts: list[str] = []
        self.links = 0
        self._read(source)

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            element = self.stack[-1][1] if self.stack else 0
            self.blocks.append(Block(self.path_of[element], element, text, min(self.links, len(text))))
        self.parts, self.links = [], 0

    def _add(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.open.get("a"):
                self.links += len(SPACE.sub(" ", text).strip())

    def _push(self, tag: str, words: str, bad: int) -> None:
        up = self.stack[-1][1] if self.stack else 0
        own = tag in BLOCK or bad > 0
        if own:
            self.tag.append(tag)
            self.parent.append(up)
            self.bad.append(bad)
            self.path_of.append(self.paths.setdefault((self.path_of[up], f"{tag}.{words}" if words else tag), len(self.paths) + 1))
            up = len(self.tag) - 1
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, up, own))

    def _close(self, k: int) -> None:
        """Close all elements from place ``k`` of the stack on."""
        while len(self.stack) > k:
            tag, _, own = self.stack[-1]
            if own:
                self._flush()
            self.stack.pop()
            self.open[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def _place(self, tags: tuple) -> int:
        """The last open element with one of the tags, -1 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _opens(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            k = self._place(("p",))
            if k >= 0 and (not self.scopes or self.scopes[-1] < k):
                self._close(k)
        if tag in CLOSES:
            k = self._place(CLOSES[tag])
            scope = next((i for i in reversed(self.scopes) if self.stack[i][0] not in ("td", "th")), -1) if k >= 0 else -1
            if k >= 0 and scope <= k:
                self._close(k)
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            self.parts.append(" " if tag in ("br", "img") else "")
            return
        words, bad = _names(attributes) if attributes.strip("/ \t\r\n") else ("", 0)
        bad = HIDDEN if tag in NEVER else bad
        # a header inside an article or section is its heading, not the site's
        if tag == "header" and not words and self._place(("article", "main", "section")) >= 0 or tag in ("html", "body", "article", "main"):
            bad = 0
        if bad and tag not in BLOCK:
            self._flush()
        if not (attributes.rstrip().endswith("/") and tag not in BLOCK):
            self._push(tag, words, bad)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._add(source[at:])
                break
            m = TOKEN.match(source, lt)
            if not m:
                self._add(source[at : lt + 1])
                at = lt + 1
                continue
            self._add(source[at:lt])
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                k = self._place((tag,))
                if tag == "br":
                    self.parts.append(" ")
                elif k >= 0:
                    self._close(k)
                elif tag in BLOCK:
                    self._flush()
            elif m[2]:
                tag = m[2].lower()
                if tag in RAW:
                    self._flush()
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else n
                else:
                    self._opens(tag, m[3] or "")
        self._close(0)
        self._flush()

    def down(self, own: list[bool]) -> list[bool]:
        """For each element whether it or one around it is marked."""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def sizes(self, chosen: list[Block]) -> list[int]:
        """The characters of the chosen blocks inside each element."""
        out = [0] * len(self.tag)
        for b in chosen:
            out[b.element] += len(b.text)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def _smooth(values: list[float]) -> list[float]:
    weights = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        a, b = max(0, i - RADIUS), min(len(values), i + RADIUS + 1)
        w = weights[a - i + RADIUS : b - i + RADIUS]
        out.append(sum(x * y for x, y in zip(values[a:b], w)) / sum(w))
    return out


def path_scores(bs: list[Block]) -> dict[int, float]:
    """The fused and smoothed ratio of each path, weighted by text."""
    sums: dict[int, list[float]] = {}
    for b in bs:
        s = sums.setdefault(b.path, [0.0, 0.0, 0])
        s[0] += len(b.text) - b.linked
        s[1] += len(MARKS.findall(b.text)) * (1 - b.linked / len(b.text))
        s[2] += 1
    text = _smooth([sums[b.path][0] / sums[b.path][2] for b in bs])
    marks = _smooth([sums[b.path][1] / sums[b.path][2] for b in bs])
    fused, weight = dict.fromkeys(sums, 0.0), dict.fromkeys(sums, 0.0)
    for b, t, m in zip(bs, text, marks):
        fused[b.path] += math.sqrt(t * m) * len(b.text)
        weight[b.path] += len(b.text)
    return {p: fused[p] / weight[p] for p in fused}


def content_paths(bs: list[Block], doubtful: set[int]) -> set[int]:
    """The paths whose score reaches the threshold; all if no score stands out (short pages without punctuation)."""
    scores = {p: s * (DOUBT if p in doubtful else 1) for p, s in path_scores(bs).items()}
    mean = sum(scores[b.path] * len(b.text) for b in bs) / sum(len(b.text) for b in bs)
    return {p for p, s in scores.items() if s > 0 and s >= THRESHOLD * mean} or set(scores) - doubtful


def main_text(source: str | None) -> str:
    """The main text of a page."""
    page = Page(source or "")
    hidden = page.down([x == HIDDEN for x in page.bad])
    bs = [b for b in page.blocks if not hidden[b.element]]
    if not bs:
        return ""
    sizes = page.sizes(bs)
    named = page.down([x == NAMED and 2 * n <= sizes[0] for x, n in zip(page.bad, sizes)])
    content = content_paths(bs, {b.path for b in bs if named[b.element]})
    chosen = [b for b in bs if b.path in content]
    # what holds most of the content: articles and mains if there are any, else the least element that holds 3/5
    held = page.sizes(chosen)
    inside = page.down([t in CONTAINERS for t in page.tag])
    if not 2 * sum(len(b.text) for b in chosen if inside[b.element]) >= held[0] > 0:
        holders = [e for e in range(1, len(held)) if 5 * held[e] >= 3 * held[0] > 0]  # one inside the other
        inside = page.down([holders[-1:] == [e] for e in range(len(held))])
        short = {b for b in bs if page.tag[b.element] not in HEADINGS and 2 * b.linked >= len(b.text)}
    else:
        short = set()
    return "\n\n".join(b.text for b in bs if b.path in content or inside[b.element] and not named[b.element] and b not in short)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(x) for x in text]})

    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
