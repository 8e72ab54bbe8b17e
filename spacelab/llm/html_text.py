"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; block-level tags end a line, and each line keeps its text and its number
of tags.  A line's ratio is its characters outside links to its tags, on a logarithmic scale.  The ratios are smoothed
with a Gaussian over neighbouring lines, and the threshold that parts them best into two clusters tells content lines
from the rest.  The smoothed ratios of the content lines, added up along the tree of block elements, choose the region:
an article or main element, or where there is none the deepest element of several lines that holds nine tenths of the
sum.  Menus compete by their ratios like anything else, at half their sum; that they are menus is what links show, and
a menu wins only on a page whose ratios say so.

Articles that stand side by side are one region.  The region is returned whole, so short paragraphs, headings and lists of links stay; only elements whose name, role,
class or id says that they are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader
comments are left out of it.  A form, class or id leaves nothing out where the element holds the page's article or most
of its text, and inside the region headings, paragraphs and sections stay whatever their class or id, unless that is the
whole name of an advert, or of reader comments on a section.  Related and recommended blocks stay where they are text and
no links.  Where a page has no article or main element, lists of links and notes on copyright beside the content are left
out if the ratios of all their lines lie under the threshold.

Pages are independent: one pass, no shuffle, one page's events in memory at once, time in proportion to the page however
deeply it is nested.

Defined results: null or empty html, or a page without content, gives an empty text with 0 characters; a very long page
is read whole; ties between regions go to the earlier one; repeated rows are extracted each; a null id or url is passed
on; bytes that are not UTF-8 read as replacement characters; an empty table gives an empty result; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import decoded, lean, portions

SIGMA = 1.0
RADIUS = 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MENUS = frozenset(("nav",))  # they compete with the other regions by their ratios
NOISE_TAGS = frozenset(
    "footer aside script style noscript template iframe object svg math canvas button select textarea head title dialog menu "
    "audio video map".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACE_TAGS = frozenset(("br", "td", "th", "option"))
#: An element of the key closes an open element of the value, up to the nearest element of ``_FENCES``.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCES = frozenset("html body article aside section main nav header footer div form table ul ol dl td th blockquote".split())
#: Blocks that are parts of a text, never the whole.
_PARTS = frozenset("address blockquote dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 legend li ol p pre summary ul".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus dropdown footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "opinions pager pagination popup promo promotion recommended related replies respond share sharing sidebar skip social sponsor sponsored "
    "sponsors subscribe teaser toc toolbar topbar widget".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense promo promotion sponsor sponsored sponsors".split())
READERS = frozenset("comment comments commentlist disqus opinions replies respond".split())
#: Never the frame of a page, unless the page's article or heading lies inside.
_ASIDES = ADVERTS | READERS | frozenset("consent cookie cookies gdpr newsletter popup recommended related subscribe teaser".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_WORD = re.compile(r"[^\W_]+")
_STATE = re.compile(r"^(has|no|with|without|is|not)[-_]|[-_](open|closed|enabled|disabled|on|off)$")
#: What a header is a header of, if not of the page.
_OF_TEXT = frozenset("article post entry story content chapter".split())
#: Names of sections of a text as well as of link lists; which of the two, links show.
_EITHER = frozenset(("related", "recommended", "social"))
_RIGHTS = re.compile(r"©|\(c\) *[12][0-9]{3}|\bcopyright\b|\ball rights reserved\b", re.I)


def _is_noise(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Noise wherever it is, by name, role or style."""
    if tag in NOISE_TAGS:
        return True
    if tag == "header":
        return not in_article
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value and value.strip().lower() in NOISE_ROLES:
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _named_noise(tag: str, attrs: list[tuple[str, str | None]], in_article: bool = False) -> tuple[frozenset[str], bool]:
    """The noise words of a class, an id or a form, and whether a heading, paragraph or section is noise even in the region.

    Names of states and layouts, such as comments-open and has-sidebar, say nothing about the element.  The header of an
    article is no page header, and an article is reader comments only where a name of it begins with that word.
    """
    words, always = {"form"} if tag == "form" else set(), False
    if tag in ("html", "body", "main"):
        return frozenset(), False
    for attribute, value in attrs:
        if attribute in ("class", "id") and value:
            names, found = value.lower().split(), set()
            for name in names:
                parts = _WORD.findall(name)
                if _STATE.search(name) or tag == "article" and not (parts and parts[0] in READERS | {"comment"}):
                    continue
                own = NOISE_WORDS.intersection(parts)
                found |= own - {"header"} if in_article or _OF_TEXT.intersection(parts) else own
            words |= found
            if found:
                always |= bool(ADVERTS.intersection(names) or tag == "section" and READERS.intersection(names))
    return frozenset(words), always


#: text, tags, link characters, element, whether a name, role or style hides it
Line = tuple[str, int, int, int, bool]


class _Lines(HTMLParser):
    """Events -> lines (text, tags, link characters, element, noise)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.kinds = [-1], [""]
        self.article_elements: set[int] = set()
        self.named: dict[int, tuple[str, frozenset[str], bool]] = {}  # elements that are noise by class, id or form
        self.open: list[tuple[str, int, bool]] = []  # tag, element before it, whether it is noise
        self.at: dict[str, list[int]] = {}  # places of each tag's open elements in ``open``
        self.fences: list[int] = []  # places of the open elements of ``_FENCES``
        self.element = 0
        self.noise = self.links = self.articles = 0
        self.parts: list[str] = []
        self.hidden: list[str] = []  # text inside noise, such as a script within a paragraph
        self.tags = self.linked = 0

    def parse_html_declaration(self, i):
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def flush(self) -> None:
        for parts, noise in ((self.parts, False), (self.hidden, True)):
            text = " ".join("".join(parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.element, noise))
                self.tags = self.linked = 0
            parts.clear()

    def _pop(self, at: int) -> None:
        while len(self.open) > at:
            tag, element, noise = self.open.pop()
            self.at[tag].pop()
            if self.fences and self.fences[-1] == len(self.open):
                self.fences.pop()
            if self.element in self.named and element != self.element and tag not in BLOCK_TAGS:
                self.flush()
            self.element = element
            self.noise -= noise
            self.links -= tag == "a"
            self.articles -= tag == "article"

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
            self._close_open(("p",), _FENCES)
        elif tag in SPACE_TAGS:
            self.parts.append(" ")
        if tag in _CLOSES:
            self._close_open(_CLOSES[tag], _FENCES - {"td", "th"} if tag == "tr" else _FENCES - set(_CLOSES[tag]))
        self.tags += 1
        if tag in VOID:
            return
        noise = _is_noise(tag, attrs, self.articles > 0)
        words, always = _named_noise(tag, attrs, self.articles > 0) if attrs or tag == "form" else ((), False)
        if words and tag in _INLINE:
            noise, words = True, ()
        if words and tag not in BLOCK_TAGS:
            self.flush()
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in _FENCES:
            self.fences.append(len(self.open))
        self.open.append((tag, self.element, noise))
        self.noise += noise
        if tag == "a":
            self.links += 1
        elif tag in BLOCK_TAGS or words:
            self.articles += tag == "article"
            self.parents.append(self.element)
            main = tag in ("article", "main") or any(n == "role" and v == "main" or n == "itemprop" and v == "articleBody" for n, v in attrs)
            self.kinds.append("main" if main and not self.noise and not (tag == "article" and words) else tag)
            self.element = len(self.parents) - 1
            if tag == "article" and self.kinds[-1] == "main":
                self.article_elements.add(self.element)
            if words:
                self.named[self.element] = (tag, words, always)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as in a browser, the slash does not close

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, -1 if none is open."""
        return max((found[-1] for t in tags if (found := self.at.get(t))), default=-1)

    def _close_open(self, tags, fences) -> None:
        """Close the innermost open element of ``tags`` unless one of ``fences`` stands in between."""
        at = self._last(tags)
        if at >= 0 and at >= ((self.fences or (-1,))[-1] if fences is _FENCES else self._last(fences)):
            self.flush()
            self._pop(at)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        self.tags += 1
        at = self._last((tag,))
        if at >= 0 and (tag in _FENCES or at > (self.fences or (-1,))[-1]):  # else an end without a start in this container
            self._pop(at)

    def handle_data(self, data):
        (self.hidden if self.noise else self.parts).append(data)
        if self.links:
            self.linked += len(data)


_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)


def line_ratios(lines: list[Line]) -> np.ndarray:
    """Logarithm of each line's characters outside links per tag."""
    return np.log1p([max(len(text) - linked, 0) / max(tags, 1) for text, tags, linked, _, _ in lines])


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean over neighbouring lines; at the ends over the lines there are."""
    own = np.convolve(ratios, _KERNEL)[RADIUS : RADIUS + len(ratios)]
    return own / np.convolve(np.ones(len(ratios)), _KERNEL)[RADIUS : RADIUS + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The least value of the upper of two clusters: the cut of the sorted values with most variance between its sides."""
    v = np.sort(values)
    n = len(v)
    if v[0] == v[-1]:
        return float(v[0])
    left = np.arange(1, n)
    sums = np.cumsum(v)[:-1]
    apart = (sums / left - (v.sum() - sums) / (n - left)) ** 2 * left * (n - left)
    apart[v[1:] == v[:-1]] = -1  # equal values are not cut apart
    return float(v[int(apart.argmax()) + 1])


class _Tree:
    """The block elements of a page, numbered in the order of their starts, so that a child is above its parent and
    an element's descendants follow it without a gap."""

    def __init__(self, parents: list[int]):
        self.parents = parents
        self.last = list(range(len(parents)))
        for e in range(len(parents) - 1, 0, -1):
            p = parents[e]
            self.last[p] = max(self.last[p], self.last[e])

    def summed(self, own: list[float]) -> list[float]:
        """Each element's own value and those of its descendants."""
        total = list(own)
        for e in range(len(total) - 1, 0, -1):
            total[self.parents[e]] += total[e]
        return total

    def below(self, marked) -> list[bool]:
        """Whether an element or one around it is marked."""
        out: list[bool] = []
        for e, p in enumerate(self.parents):
            out.append(bool(marked(e)) or p >= 0 and out[p])
        return out

    def inside(self, element: int, top: int) -> bool:
        return top <= element <= self.last[top]


def _per_element(count: int, lines: list[Line], value) -> list[float]:
    own = [0.0] * count
    for i, x in enumerate(lines):
        own[x[3]] += value(i, x)
    return own


def _frames(lines: list[Line], tree: _Tree, kinds: list[str], named: dict) -> set[int]:
    """Elements named like noise that hold the page's article or most of its text."""
    count = len(kinds)
    plain = _per_element(count, lines, lambda i, x: 0 if x[4] else len(x[0]))
    total = tree.summed(plain)
    heads = [0.0] * count  # text in headings or main elements below
    for e in range(count - 1, 0, -1):
        p = tree.parents[e]
        heads[p] += total[e] if kinds[e] in ("main", "h1") else heads[e]
    holds = {e for e in named if heads[e] > 0}
    aside = tree.below(lambda e: e in named and named[e][1] & _ASIDES and e not in holds)
    kept = [0.0 if aside[e] else n for e, n in enumerate(plain)]
    if not any(kept):
        kept = plain
    size = tree.summed(kept)
    headed, free = tree.below(lambda e: kinds[e] in ("main", "h1")), tree.below(lambda e: e in named)
    shown = any(n and headed[e] and not free[e] for e, n in enumerate(plain))
    return {e for e in named if size[e] > size[0] / 2 and e in holds or size[e] > 0.75 * size[0] and not shown and kinds[e] != "article"}


def main_lines(lines: list[Line], parents: list[int], kinds: list[str], named: dict, articles: set[int] = frozenset()) -> list[str]:
    """The lines of the region that the ratios choose, without noise."""
    if not lines:
        return []
    tree, count = _Tree(parents), len(kinds)
    shown = _frames(lines, tree, kinds, named) if named else set()
    # a heading is never the frame of something else
    shown |= {e for e, (tag, _, always) in named.items() if tag in _HEADINGS and not always}
    hidden = tree.below(lambda e: e in named and e not in shown)
    menu = tree.below(lambda e: kinds[e] in MENUS)
    values = smoothed(line_ratios(lines))
    cut = threshold(values)
    free = [not x[4] and not hidden[x[3]] for x in lines]
    if not any(f and not menu[x[3]] for f, x in zip(free, lines)):
        return []
    content = [float(v) if f and v >= cut else 0.0 for f, v in zip(free, values)]
    if not any(content):  # no text outside links, or content lines that are all noise: the other lines count alike
        content = [float(f and not menu[x[3]]) for f, x in zip(free, lines)]
    sums = tree.summed(_per_element(count, lines, lambda i, x: content[i] / 2 if menu[x[3]] else content[i]))
    tops = [e for e, kind in enumerate(kinds) if kind in MENUS or kind == "main"]
    nested = tree.summed([sums[e] if kinds[e] == "main" else 0.0 for e in range(count)])
    # a main element's sum without those of main elements in it, so that the nearest around the lines counts
    own = {e: sums[e] if kinds[e] in MENUS else sums[e] - _nested(tree, kinds, sums, e, nested) for e in tops}
    best = max(own, key=lambda e: (own[e], -e), default=0)
    beside: set[int] = set()
    if not any(kinds[e] == "main" and own[e] > 0 for e in tops) and (not best or own[best] <= sums[0] / 2):
        texts = [0.0 if menu[x[3]] else c for c, x in zip(content, lines)]
        best = _common(lines, tree, kinds, texts, free, menu)
        beside = _beside(lines, tree, kinds, texts, best, cut)
    elif own[best] <= 0:
        return []
    together = []
    if best in articles and len(articles) > 1:
        told = _told(lines, tree)
        together = [e for e in articles if parents[e] == parents[best] and 10 * told[e] >= max(told[best], 1) and not hidden[e]]
    regions = sorted({best, *together})
    if len(regions) > 1 and kinds[parents[best]] == "main":  # articles of one main element: all that it holds
        regions = [parents[best]]
    if len(regions) == 1:
        return _region(lines, tree, kinds, named, shown, hidden, menu, regions[0], beside)
    # each from its own lines, so that time stays in proportion
    owner, mine = {}, {top: [] for top in regions}
    for top in regions:
        owner.update(dict.fromkeys(range(top, tree.last[top] + 1), top))
    for x in lines:
        if x[3] in owner:
            mine[owner[x[3]]].append(x)
    return [x for top in regions for x in _region(mine[top], tree, kinds, named, shown, hidden, menu, top)]


def _told(lines: list[Line], tree: _Tree) -> list[int]:
    """Characters of each element that is mostly text outside links, 0 for others, such as a card that links to a text."""
    own = lambda value: tree.summed(_per_element(len(tree.parents), lines, lambda i, x: 0 if x[4] else value(x)))
    return [int(size) if 2 * linked < size else 0 for linked, size in zip(own(lambda x: x[2]), own(lambda x: len(x[0])))]


def _beside(lines: list[Line], tree: _Tree, kinds: list[str], content: list[float], top: int, cut: float) -> set[int]:
    """Children of a region without article or main element that are no part of its text: under the threshold in every
    line, beside the child that has most of the sum, and lists of links or, after it, notes on copyright."""
    sums = tree.summed(_per_element(len(kinds), lines, lambda i, x: content[i]))
    children = [e for e, p in enumerate(tree.parents) if p == top]
    core = max(children, key=lambda e: (sums[e], -e), default=None)
    if core is None or sums[core] < 0.6 * sums[top]:
        return set()
    ratios, mine, child = line_ratios(lines), {e: [] for e in children}, [-1] * len(kinds)
    for e in range(top + 1, tree.last[top] + 1):
        child[e] = e if tree.parents[e] == top else child[tree.parents[e]]
    for i, x in enumerate(lines):
        if child[x[3]] >= 0:
            mine[child[x[3]]].append(i)
    out = set()
    for e, own in mine.items():
        if e != core and own and all(ratios[i] < cut for i in own):
            linked, size = sum(lines[i][2] for i in own), sum(len(lines[i][0]) for i in own)
            if 2 * linked > size and len(own) > 1 or e > core and any(_RIGHTS.search(lines[i][0]) for i in own):
                out.add(e)
    return out


def _nested(tree: _Tree, kinds: list[str], sums: list[float], top: int, nested: list[float]) -> float:
    """Sum of the outermost main elements below ``top``."""
    if nested[top] == sums[top]:
        return 0.0
    out, e = 0.0, top + 1
    while e <= tree.last[top]:
        if kinds[e] == "main":
            out += sums[e]
            e = tree.last[e]
        e += 1
    return out


def _common(lines: list[Line], tree: _Tree, kinds: list[str], content: list[float], free: list[bool], menu: list[bool]) -> int:
    """The deepest element of several lines that holds nine tenths of the sum outside menus."""
    sums = tree.summed(_per_element(len(kinds), lines, lambda i, x: content[i]))
    lying = tree.summed(_per_element(len(kinds), lines, lambda i, x: float(free[i] and not menu[x[3]])))
    top = max(e for e, n in enumerate(sums) if n >= 0.9 * sums[0])
    while top and (kinds[top] in _PARTS or lying[top] < 2 <= lying[0]):
        top = tree.parents[top]  # a single paragraph, list or cell is no region
    return top


def _region(
    lines, tree: _Tree, kinds: list[str], named: dict, shown: set[int], hidden: list[bool], menu: list[bool], top: int, beside: set[int] = frozenset()
) -> list[str]:
    if beside:
        left = tree.below(lambda e: e in beside)
        lines = [x for x in lines if not left[x[3]]]
    if named:  # headings, paragraphs and sections of the region stay whatever their names
        page_wide = kinds[top] in ("", "html", "body")
        texts = {e for e, (tag, words, always) in named.items() if not always and (tag == "p" or tag == "section") and not (page_wide and words & _ASIDES)}
        either = [e for e, (tag, words, always) in named.items() if not always and not page_wide and words <= _EITHER and tree.inside(e, top)]
        told = _told(lines, tree) if either else []
        texts |= {e for e in either if told[e]}
        hidden = tree.below(lambda e: e in named and e not in shown and e not in texts and not tree.inside(top, e))
    asked = menu[top]
    return [x[0] for x in lines if not x[4] and tree.inside(x[3], top) and not hidden[x[3]] and (asked or not menu[x[3]])]


def extract(html: str | None) -> str:
    """The main text of a page: blocks joined by an empty line."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n\n".join(main_lines(parser.lines, parser.parents, parser.kinds, parser.named, parser.article_elements))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: id, url, text, n_chars."""
    schema = T.StructType([
        T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "html"):
                texts = [extract(h) for h in decoded(part.column("html"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["id", "url", "text", "n_chars"])

    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return read.mapInArrow(lean(run), schema).withColumnsRenamed({"id": id_col, "url": url_col})


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The same texts for pages whose article element holds plain paragraphs, with their character references.
ORACLE = r"""
WITH art AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS a FROM pages),
blk AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(p|h1)>'), lambda b: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
    '\s+', ' ', 'g'))) AS b FROM art),
txt AS (SELECT page_id, url, coalesce(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM blk)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM txt
"""
