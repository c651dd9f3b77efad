"""Main text of web pages from flat text blocks (operator 9).

A page is cut into flat blocks of text at block-level tags. A block is described by its words, the share of them inside
links and the same of the blocks before and after it; one more number says how much the tags around it speak against an
article. A small decision tree, grown from the labelled table below when the module is first used, tells article from
the rest: link density parts most menus, and where tags say little or contradict the text its measures decide.

The scanner reads a page once: a tag's end is looked for once, open tags are counted by name, and what stays unclosed
is remembered, so time is in proportion to the page whatever it holds.

Defined results: null or empty html gives an empty text; rows are independent, so repeated ids each get their result;
an empty table gives an empty table; other columns are ignored; tags that are never closed end with the page or where an
outer tag ends; a tag without an end is text, a comment without one reaches to the end of the page.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_rows

#: Tags whose content is never text of the page; of these, those that hold characters and no tags.
RAW = frozenset("script style noscript template textarea iframe svg title math object select canvas audio video".split())
CHARACTERS = frozenset("script style textarea iframe title".split())
#: Tags inside a line of text; every other tag parts blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of a page that are no article, by tag, by role and by words in class or id.
PARTS = frozenset("nav footer aside button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset(
    "nav navbar navigation menu header masthead topbar footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright disclaimer form search skip hidden tags".split()
)
#: Names that parts of an article's subject have as well.
VAGUE = frozenset("discussion legal".split())
#: Words that say nothing more about a part beside its name.
FILLERS = frozenset(
    "area article articles bar block body bottom box button col component container content div footer global group heading holder inner item items link links list main mobile module my outer page panel post posts primary reader readers root row secondary section site slot text the title top unit user users wrap wrapper zone".split()
)
#: Of the names, those that an article's own parts have too, and names of such parts.
HEADS, ARTICLE_NAMES = frozenset("header masthead banner".split()), frozenset("article post entry story content".split())
#: Names that count on a tag inside a line of text.
INLINE_NAMES = frozenset("ad ads advert adverts advertisement sponsored hidden share sharing skip".split())
#: Tags whose next one ends them.
ITEMS = frozenset("p li td th tr dt dd option a".split())
#: How a part speaks against an article: not, by a name among other words, by its name, by its tag, role or hiding; a form
#: outside an article may hold the whole page.
PLAIN, VAGUELY, NAMED, CERTAIN, FORM = range(5)

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: A tag's attributes up to its end, quoted values skipped; and the same where quotes have proved to be unpaired.
_QUOTED = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')|["'=])*+)>""")
_UNQUOTED = re.compile(r"([^>]*+)>")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden|href)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?(?=[\s/]|$)""", re.I)
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"&#([xX]?)([0-9]{8,}|(?<=[xX])[0-9a-fA-F]{8,});?")
_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}

#: Labelled blocks: words, link density, words and link density before, words and link density after, and what the tags
#: say against an article: 0 in an article, 1 a page without, 2 and 3 the same in a part of a vague name, 4 outside the
#: page's article or in a form, 5 in a part named as no article, 6 in a tag for such parts. Label 1 is article text.
TABLE = np.array([
    [11, 0.0, 8, 0.0, 95, 0.0, 0, 1], [95, 0.0, 11, 0.0, 80, 0.0, 0, 1], [4, 0.0, 60, 0.0, 70, 0.0, 0, 1], [8, 0.0, 9, 0.0, 7, 0.0, 0, 1],
    [160, 0.02, 90, 0.0, 12, 0.0, 0, 1], [30, 0.25, 50, 0.0, 66, 0.0, 0, 1], [2, 0.0, 30, 0.0, 12, 0.0, 0, 1], [1, 0.0, 0, 0.0, 12, 0.0, 0, 1],
    [22, 0.6, 40, 0.1, 30, 0.0, 0, 1], [60, 0.0, 5, 0.0, 2, 1.0, 0, 1], [10, 0.0, 8, 0.0, 3, 1.0, 0, 1], [4, 0.0, 0, 0.0, 0, 0.0, 0, 1],
    [5, 0.0, 8, 0.0, 4, 0.0, 0, 1], [90, 0.0, 3, 0.0, 0, 0.0, 0, 1], [1, 0.0, 1, 0.0, 1, 0.0, 0, 1], [7, 0.0, 90, 0.0, 2, 0.0, 0, 1],
    [3, 0.0, 2, 1.0, 4, 0.0, 0, 1], [2, 0.5, 20, 0.0, 4, 0.0, 0, 1], [8, 0.38, 20, 0.0, 1, 1.0, 0, 1], [8, 0.4, 0, 0.0, 3, 1.0, 0, 1],
    [12, 0.0, 3, 1.0, 2, 1.0, 0, 1], [3, 0.0, 1, 1.0, 1, 1.0, 0, 1], [8, 1.0, 12, 0.0, 90, 0.0, 0, 1], [10, 1.0, 0, 0.0, 120, 0.02, 0, 1],
    [3, 0.0, 60, 0.0, 40, 0.0, 0, 1], [3, 0.0, 90, 0.0, 0, 0.0, 0, 1], [2, 0.0, 70, 0.0, 60, 0.0, 0, 1], [8, 0.0, 5, 1.0, 30, 0.0, 0, 1],
    [20, 0.0, 3, 1.0, 0, 0.0, 0, 1], [12, 0.0, 4, 0.9, 0, 0.0, 0, 1], [5, 0.0, 8, 1.0, 6, 0.0, 0, 1], [6, 0.0, 40, 0.0, 2, 1.0, 0, 1],
    [3, 0.0, 35, 0.0, 8, 0.0, 0, 1], [3, 0.0, 50, 0.0, 3, 1.0, 0, 1], [2, 0.0, 90, 0.0, 2, 1.0, 0, 1], [4, 0.0, 30, 0.0, 2, 1.0, 0, 1],
    [2, 0.0, 2, 1.0, 2, 1.0, 0, 1], [1, 0.0, 60, 0.0, 0, 0.0, 0, 1], [3, 0.0, 40, 0.1, 3, 0.0, 0, 1], [16, 0.0, 2, 1.0, 90, 0.0, 0, 1],
    [8, 1.0, 9, 1.0, 7, 1.0, 0, 0], [9, 1.0, 60, 0.0, 8, 1.0, 0, 0], [10, 1.0, 12, 1.0, 0, 0.0, 0, 0], [7, 1.0, 30, 0.0, 0, 0.0, 0, 0],
    [3, 1.0, 5, 1.0, 4, 1.0, 0, 0], [5, 1.0, 70, 0.0, 5, 1.0, 0, 0], [2, 1.0, 90, 0.0, 10, 0.0, 0, 0], [1, 1.0, 1, 1.0, 1, 1.0, 0, 0],
    [4, 0.75, 3, 1.0, 3, 1.0, 0, 0], [2, 1.0, 1, 1.0, 90, 0.0, 0, 0], [1, 1.0, 2, 1.0, 0, 0.0, 0, 0], [6, 1.0, 80, 0.0, 0, 0.0, 0, 0],
    [90, 0.0, 12, 0.0, 70, 0.0, 1, 1], [40, 0.0, 3, 0.0, 60, 0.0, 1, 1], [35, 0.1, 80, 0.0, 9, 0.0, 1, 1], [18, 0.0, 45, 0.0, 50, 0.0, 1, 1],
    [9, 0.0, 30, 0.0, 60, 0.0, 1, 1], [150, 0.2, 5, 1.0, 6, 1.0, 1, 1], [6, 0.0, 70, 0.0, 65, 0.0, 1, 1], [10, 0.0, 2, 1.0, 80, 0.0, 1, 1],
    [12, 0.0, 0, 0.0, 90, 0.0, 1, 1], [25, 0.0, 60, 0.0, 0, 0.0, 1, 1], [14, 0.0, 20, 0.0, 25, 0.0, 1, 1], [11, 0.0, 15, 0.0, 14, 0.0, 1, 1],
    [3, 0.0, 0, 0.0, 0, 0.0, 1, 1], [12, 0.0, 0, 0.0, 0, 0.0, 1, 1], [4, 0.0, 5, 0.0, 0, 0.0, 1, 1], [70, 0.0, 90, 0.0, 2, 1.0, 1, 1],
    [3, 1.0, 2, 1.0, 2, 1.0, 1, 0], [8, 1.0, 6, 1.0, 9, 1.0, 1, 0], [5, 0.6, 4, 1.0, 3, 0.8, 1, 0], [4, 0.0, 2, 1.0, 3, 1.0, 1, 0],
    [2, 0.0, 0, 0.0, 3, 0.9, 1, 0], [25, 0.7, 60, 0.0, 20, 0.8, 1, 0], [6, 0.0, 4, 0.9, 0, 0.0, 1, 0], [40, 0.8, 30, 0.7, 20, 0.9, 1, 0],
    [12, 0.5, 8, 0.9, 5, 1.0, 1, 0], [5, 0.0, 0, 0.0, 2, 1.0, 1, 0], [9, 0.0, 3, 1.0, 0, 0.0, 1, 0], [2, 1.0, 80, 0.0, 2, 1.0, 1, 0],
    [1, 1.0, 1, 1.0, 40, 0.0, 1, 0], [2, 1.0, 2, 1.0, 12, 0.0, 1, 0], [5, 0.9, 60, 0.0, 70, 0.0, 1, 0], [3, 1.0, 90, 0.0, 0, 0.0, 1, 0],
    [1, 1.0, 0, 0.0, 1, 1.0, 1, 0], [6, 1.0, 7, 1.0, 60, 0.0, 1, 0], [2, 1.0, 40, 0.0, 30, 0.0, 1, 0], [9, 1.0, 8, 1.0, 0, 0.0, 1, 0],
    [7, 0.0, 12, 0.0, 40, 0.0, 2, 1], [45, 0.0, 20, 0.0, 30, 0.0, 2, 1], [90, 0.02, 8, 0.0, 60, 0.0, 2, 1], [5, 0.0, 40, 0.0, 30, 0.0, 2, 1],
    [12, 0.1, 6, 0.0, 70, 0.0, 2, 1], [60, 0.0, 90, 0.0, 0, 0.0, 2, 1], [2, 0.0, 60, 0.0, 50, 0.0, 2, 1], [7, 0.0, 2, 0.0, 0, 0.0, 2, 1],
    [14, 0.0, 2, 0.0, 2, 1.0, 2, 1], [10, 0.0, 5, 0.0, 3, 1.0, 2, 1], [20, 0.1, 30, 0.0, 0, 0.0, 2, 1], [9, 0.0, 3, 0.0, 25, 0.0, 2, 1],
    [2, 1.0, 60, 0.0, 2, 1.0, 2, 0], [3, 1.0, 3, 1.0, 3, 1.0, 2, 0], [6, 0.6, 80, 0.0, 4, 1.0, 2, 0], [2, 0.0, 90, 0.0, 1, 1.0, 2, 0],
    [3, 0.0, 70, 0.0, 3, 1.0, 2, 0], [3, 0.0, 60, 0.0, 0, 0.0, 2, 0], [4, 0.0, 30, 0.0, 2, 1.0, 2, 0], [2, 0.0, 2, 1.0, 2, 1.0, 2, 0],
    [4, 1.0, 40, 0.0, 50, 0.0, 2, 0], [1, 1.0, 1, 1.0, 60, 0.0, 2, 0], [2, 1.0, 3, 1.0, 45, 0.0, 3, 0], [5, 1.0, 50, 0.0, 40, 0.0, 3, 0],
    [60, 0.0, 50, 0.0, 45, 0.0, 3, 1], [35, 0.0, 12, 0.0, 80, 0.0, 3, 1], [90, 0.05, 30, 0.0, 0, 0.0, 3, 1], [28, 0.0, 40, 0.0, 40, 0.0, 3, 1],
    [8, 0.0, 60, 0.0, 0, 0.0, 3, 0], [14, 0.0, 30, 0.0, 3, 1.0, 3, 0], [3, 1.0, 3, 1.0, 3, 1.0, 3, 0], [10, 0.0, 40, 0.0, 2, 0.0, 3, 0],
    [12, 0.5, 50, 0.0, 6, 1.0, 3, 0], [6, 0.0, 0, 0.0, 3, 1.0, 3, 0], [20, 0.1, 3, 1.0, 4, 1.0, 3, 0], [18, 0.0, 2, 0.0, 9, 0.0, 3, 0],
    [70, 0.0, 60, 0.0, 55, 0.0, 4, 1], [120, 0.02, 80, 0.0, 90, 0.0, 4, 1], [60, 0.0, 45, 0.0, 90, 0.0, 4, 1], [50, 0.05, 70, 0.0, 60, 0.0, 4, 1],
    [2, 0.0, 0, 0.0, 8, 0.0, 4, 0], [8, 0.0, 2, 0.0, 6, 0.0, 4, 0], [8, 0.0, 2, 0.0, 11, 0.0, 4, 0], [12, 0.0, 90, 0.0, 0, 0.0, 4, 0],
    [25, 0.0, 90, 0.0, 0, 0.0, 4, 0], [30, 0.0, 4, 0.0, 8, 0.0, 4, 0], [5, 1.0, 5, 1.0, 5, 1.0, 4, 0], [3, 0.0, 3, 1.0, 2, 1.0, 4, 0],
    [35, 0.0, 80, 0.0, 6, 0.0, 4, 0], [60, 0.0, 90, 0.0, 0, 0.0, 4, 0], [60, 0.0, 3, 0.0, 90, 0.0, 4, 0], [30, 0.0, 90, 0.0, 80, 0.0, 4, 0],
    [8, 0.0, 1, 1.0, 11, 0.0, 5, 0], [30, 0.0, 120, 0.0, 0, 0.0, 5, 0], [60, 0.0, 90, 0.0, 55, 0.0, 5, 0], [3, 0.0, 60, 0.0, 25, 0.0, 5, 0],
    [120, 0.05, 3, 0.0, 80, 0.0, 5, 0], [90, 0.0, 80, 0.0, 95, 0.0, 5, 0], [90, 0.0, 20, 0.0, 12, 0.0, 5, 0], [100, 0.0, 60, 0.0, 0, 0.0, 5, 0],
    [2, 1.0, 1, 0.0, 40, 0.0, 5, 0], [5, 1.0, 5, 1.0, 6, 1.0, 5, 0], [7, 1.0, 8, 1.0, 7, 1.0, 5, 0], [3, 0.8, 12, 0.0, 60, 0.0, 5, 0],
    [9, 0.0, 1, 1.0, 11, 0.0, 6, 0], [14, 0.0, 90, 0.0, 0, 0.0, 6, 0], [60, 0.0, 90, 0.0, 55, 0.0, 6, 0], [120, 0.05, 3, 0.0, 80, 0.0, 6, 0],
    [90, 0.0, 80, 0.0, 95, 0.0, 6, 0], [110, 0.0, 30, 0.0, 0, 0.0, 6, 0], [1, 1.0, 1, 1.0, 1, 1.0, 6, 0], [1, 1.0, 1, 1.0, 9, 0.0, 6, 0],
    [2, 1.0, 2, 1.0, 2, 1.0, 6, 0], [6, 1.0, 0, 0.0, 1, 1.0, 6, 0], [3, 1.0, 1, 1.0, 2, 1.0, 6, 0], [2, 1.0, 60, 0.0, 2, 1.0, 6, 0],
    [70, 0.1, 60, 0.0, 0, 0.0, 5, 0], [7, 1.0, 3, 1.0, 95, 0.0, 5, 0], [9, 1.0, 0, 0.0, 120, 0.0, 5, 0], [60, 0.05, 8, 0.0, 10, 0.0, 5, 0],
    [80, 0.1, 20, 0.0, 12, 0.0, 6, 0], [6, 1.0, 5, 1.0, 100, 0.0, 6, 0], [12, 0.6, 0, 0.0, 90, 0.0, 6, 0], [75, 0.2, 4, 0.0, 0, 0.0, 6, 0],
    [95, 0.05, 30, 0.0, 10, 0.0, 5, 0], [90, 0.05, 12, 0.0, 0, 0.0, 4, 0], [100, 0.1, 80, 0.0, 0, 0.0, 6, 0], [110, 0.04, 20, 0.0, 9, 0.0, 6, 0],
    [4, 1.0, 3, 1.0, 12, 0.0, 6, 0], [1, 1.0, 1, 1.0, 70, 0.0, 6, 0], [2, 1.0, 0, 0.0, 30, 0.0, 6, 0], [5, 0.8, 2, 1.0, 3, 1.0, 6, 0],
])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9):
    """A tree of (feature, threshold, left, right) or the share of label 1, split where Gini impurity falls most."""
    if depth == 0 or len(set(y)) == 1:
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < t
            cost = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t)
    if best is None:
        return float(y.mean())
    _, f, t = best
    left = x[:, f] < t
    return f, float(t), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@functools.cache
def tree():
    return grow(TABLE[:, :-1], TABLE[:, -1].astype(int))


def chance(row, node) -> float:
    while not isinstance(node, float):
        node = node[2] if row[node[0]] < node[1] else node[3]
    return node


def _words(token: str) -> list[str]:
    """Words of one name of a class or id; those after `has`, `with` or `no` describe what else the page has."""
    parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())
    return [w for before, w in zip(["", *parts], parts, strict=False) if before not in ("has", "with", "no")]


@functools.lru_cache(50_000)
def _named(value: str, tag: str, in_article: bool) -> int:
    """What the names in a class or id say."""
    found, tokens = PLAIN, [_words(t) for t in value.split()]
    own = any(ARTICLE_NAMES & set(t) for t in tokens)
    if tag == "article" and own:
        return PLAIN
    for words in tokens:
        names = NAMES & set(words)
        if in_article or own:
            names -= HEADS
        if tag in INLINE:
            names &= INLINE_NAMES
        if names and all(w in NAMES or w in FILLERS for w in words):
            return NAMED
        if names or VAGUE & set(words):
            found = VAGUELY
    return PLAIN if tag == "article" else found


def _kind(tag: str, attrs: str, in_article: bool) -> int:
    if tag in PARTS or tag == "header" and not in_article:
        return CERTAIN
    found = PLAIN if tag != "form" else NAMED if in_article else FORM
    for k, v in _ATTR.findall(attrs) if attrs else ():
        k, v = k.lower(), v.strip("\"'")
        low = v.lower()
        if k == "role" and low.strip() in ROLES or k == "hidden" or k == "aria-hidden" and low == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            return CERTAIN
        if k in ("class", "id") and tag not in ("html", "body", "main"):
            named = _named(v[:1000], tag, in_article)
            found = named if found in (PLAIN, VAGUELY) else found
    return found


def _short(m: re.Match) -> str:
    """A long numeric reference without its leading zeros; a number beyond Unicode is no character."""
    digits = m[2].lstrip("0")
    return f"&#{m[1]}{digits or 0};" if len(digits) < 8 else "\ufffd"


class _Page:
    """Collects blocks while the tags of a page go by."""

    def __init__(self):
        #: Text, words, words in links, open parts by kind, open articles and mains.
        self.out: list[tuple[str, int, int, tuple[int, ...], int, int]] = []
        #: Open tags: name, kind, whether a link, and the kinds that an article has set aside.
        self.stack: list[tuple[str, int, bool, list[int] | None]] = []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.link_words = self.links = self.mute = 0
        self.odd = [0] * 5
        self.seen = False

    def close(self) -> None:
        """Ends the block."""
        if self.parts:
            raw = "".join(self.parts)
            if "&" in raw:
                raw = html.unescape(_NUMBER.sub(_short, raw))
            text = _SPACE.sub(" ", raw).strip()
            if text:
                n = text.count(" ") + 1
                self.out.append((text, n, min(n, self.link_words), tuple(self.odd), self.open["article"], self.open["main"]))
            self.parts.clear()
        self.link_words = 0

    def add(self, raw: str) -> None:
        if raw and not self.mute:
            self.parts.append(raw)
            if self.links:
                self.link_words += len(raw.split())

    def push(self, tag: str, attrs: str) -> None:
        kind, aside = _kind(tag, attrs, self.open["article"] + self.open["main"] > 0), None
        if tag in INLINE:
            self.mute += kind > VAGUELY
        else:
            if tag in ("article", "main") and kind == PLAIN:  # names of wrappers say nothing about the page's article
                aside = list(self.odd)
                self.odd[VAGUELY] = 0
                if not self.seen:
                    self.odd[NAMED] = self.odd[FORM] = 0
                self.seen = True
            self.odd[kind] += 1
        link = tag == "a" and "href" in attrs.lower()
        self.links += link
        self.stack.append((tag, kind, link, aside))
        self.open[tag] += 1

    def pop(self) -> None:
        tag, kind, link, aside = self.stack.pop()
        if tag in INLINE:
            self.mute -= kind > VAGUELY
        elif aside:
            self.odd = aside
        else:
            self.odd[kind] -= 1
        self.links -= link
        self.open[tag] -= 1

    def end(self, tag: str) -> None:
        """Ends the innermost such tag and what is open in it; an inline tag ends no block."""
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                if tag in INLINE and self.stack[-1][0] not in INLINE:
                    return
                self.pop()
            self.pop()

    def begin(self, tag: str, attrs: str) -> None:
        if tag in VOID or attrs.endswith("/") and tag in INLINE:
            return
        if tag == "a":  # links hold no links
            if self.links:
                self.end("a")
        elif tag in ITEMS:  # a new paragraph or item ends the one before, and inline tags left open in it
            while self.stack and (self.stack[-1][0] == tag or self.stack[-1][0] in INLINE):
                self.pop()
        self.push(tag, attrs)


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, what the tags say against an article) of each flat block in page order."""
    p, pos, start, body, unclosed = _Page(), 0, 0, _QUOTED, set()
    while (i := page.find("<", pos)) >= 0:
        after = page[i + 1 : i + 2]
        name = _NAME.match(page, i + 1)
        if not name:
            if after not in ("!", "?", "/"):  # a mark in the text
                pos = i + 1
                continue
            comment = page.startswith("<!--", i)
            end = page.find("-->" if comment else ">", i + 2)
            if end < 0 and not comment:
                break
            p.add(page[start:i])
            start = pos = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        rest = body.match(page, name.end())
        if not rest and body is _QUOTED:  # quotes hide every end from here on: they are not paired
            body = _UNQUOTED
            rest = body.match(page, name.end())
        if not rest:  # no tag ends any more
            break
        tag, attrs = name[1].lower(), rest[1]
        p.add(page[start:i])
        start = pos = rest.end()
        if tag not in INLINE and tag not in RAW:
            p.close()
        elif tag == "br":
            p.add(" ")
        if after == "/":
            p.end(tag)
        elif tag in RAW:
            if attrs.endswith("/") and tag not in CHARACTERS or tag in unclosed:
                continue
            end = _ENDS[tag].search(page, pos)
            if end:
                close = page.find(">", end.end())
                start = pos = close + 1 if close >= 0 else len(page)
            elif tag in CHARACTERS:
                start = pos = len(page)
            else:
                unclosed.add(tag)
        else:
            p.begin(tag, attrs)
    p.add(page[start:])
    p.close()
    articles, mains = any(b[4] for b in p.out), any(b[5] for b in p.out)
    return [(text, n, k, _against(odd, articles, mains, a, m)) for text, n, k, odd, a, m in p.out]


def _against(odd: tuple[int, ...], articles: bool, mains: bool, article: int, main: int) -> int:
    inside = article > 0 if articles else main > 0
    if odd[CERTAIN] or odd[NAMED]:
        return 6 if odd[CERTAIN] else 5
    if odd[FORM] or (articles or mains) and not inside and not main:
        return 4
    return (2 if odd[VAGUELY] else 0) + (not inside)


def main_text(page: str | None) -> str:
    """The article's blocks, one on a line."""
    found = blocks(page or "")
    plain, kept = [(n, k / n) for _, n, k, _ in found], []
    for i, (text, n, k, against) in enumerate(found):
        before, after = plain[i - 1] if i else (0, 0.0), plain[i + 1] if i + 1 < len(plain) else (0, 0.0)
        if chance((n, k / n, *before, *after, against), tree()) >= 0.5:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def make():
        def of(batch):
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            return {"page_id": batch.column("page_id").to_pylist(), "url": batch.column("url").to_pylist(), "text": texts, "n_chars": [len(t) for t in texts]}

        return of

    return map_rows(pages.select("page_id", "url", F.col(html_col).alias("html")), "page_id long, url string, text string, n_chars long", make)
