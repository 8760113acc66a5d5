"""HTML main-text extraction by two passes of block rules.

A page is cut into blocks at block-level tags. Pass 1 decides a block from its stop-word density, length
and link density, on every page alike: blocks inside boilerplate containers (by tag, role, class or
id) are bad whatever they say; all others follow the density rules, which leave short and middling blocks
open, and those without links that have few stop words. An article or main element is a prior: what stands directly
inside one is judged one step better, so that it is good or open, never bad outright; blocks outside it are judged as on
any page. Pass 2 gives each open block the label of its nearest decided neighbours: a heading goes with what follows, equal labels on
both sides pass over, otherwise middling blocks next to content are kept and short ones go with the nearer side (bad on
a tie). What a container or a prior decided is no neighbour, as it says nothing about the text beside it; a page
without any neighbour and without an article keeps its open paragraphs and headings. Inside an article or main element open blocks are kept,
but short blocks of links only if some block of the page inside such elements is good or middling.

A tag left open ends with its parent; comments, scripts, styles, forms and other hidden elements have no
text. An unfinished tag at the end of a page is dropped; after a tag with a quote that never ends, quotes are not
heeded. A page is read once, in time that grows with its length whatever stands in it. Null and empty pages have an empty
text, pages that repeat a row each, an empty table no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.work import map_batches

#: Function words by which running text is known, per language.
STOP_WORDS = frozenset(
    """
    the of and to in is that it for was on are as with be at by this have from or had not but what all were when we there can an which their if will
    a he his she her they you i do has been who more no so out up its than about into them other some would time only new could these may then any also after first two
    der die und das von zu den mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn
    le la les de des et un une du en que qui dans pour pas au sur ne se ce il elle par avec son plus sont ou est cette aux ses mais comme nous vous leur été ont être fait même ces
    el los las y del se por con una su para es lo como más pero sus ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde nos mi porque qué sólo han hay
    """.split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without readable text; their content is skipped to the end tag.
RAW_TAGS = frozenset("script style textarea title template noscript iframe svg math select object applet audio video canvas xmp noframes".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form tablist".split())
#: Words of class and id attributes, cut at anything but letters and digits.
BAD_WORDS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored sponsors promo promotion promoted
    nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc sidebar aside rail widget widgets
    header masthead topbar footer foot bottombar copyright legal imprint
    comment comments commentlist discussion respond replies reply disqus
    cookie cookies consent gdpr notice notices alert popup modal overlay toast
    share sharing social related recommended recommendations trending newsletter subscribe subscription signup login signin paywall
    form search searchbox tags tagcloud byline meta hidden skip
    """.split()
)
MAIN_TAGS = frozenset(("article", "main"))
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_HIGH = 70, 200, 0.18, 0.28, 0.34

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_CUES = re.compile(r"[a-z0-9]+")
#: Open tags that an opening tag of the key closes, unless one of _BOUNDS stands between.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


_BOUNDS = frozenset("ul ol dl table div article section select".split())
_LINKED = _BOUNDS.union(*_CLOSES.values())


@dataclass
class Block:
    text: str
    link_chars: int
    bad: bool
    main: bool
    heading: bool = False
    paragraph: bool = False
    label: str = ""


def _cues(tag: str, raw: str, in_main: bool) -> bool:
    """Whether an opening tag begins boilerplate."""
    if tag in BAD_TAGS and not (tag == "header" and in_main):
        return True
    if not raw.strip():
        return False
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            # The page's own root elements are named for layout, not content.
            if tag not in ("html", "body", "article", "main") and not BAD_WORDS.isdisjoint(_CUES.findall(value)):
                return True
            if tag == "article" and {"comment", "comments", "reply", "ad", "ads", "sponsored", "promo", "related"} & set(_CUES.findall(value)):
                return True
        elif name == "role" and value in BAD_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """Text and tags in order: (text, None) or ("", match of a tag with its slash, name and attributes); raw elements are skipped."""
    pos, n, last, tag_of = 0, len(page), page.rfind(">"), _TAG
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            yield page[pos:], None
            return
        mark = page[at + 1 : at + 2]
        if mark in ("!", "?"):
            ends = ("-->", 4) if page.startswith("<!--", at) else ("]]>", 9) if page.startswith("<![CDATA[", at) else (">", 2)
            end = page.find(ends[0], at + ends[1])
            yield page[pos:at], None
            if ends[0] == "]]>":
                yield " ", None
            pos = end + len(ends[0]) if end >= 0 else n
            continue
        m = tag_of.match(page, at) if at < last else None
        if m is None and at < last and tag_of is _TAG and _BARE_TAG.match(page, at):
            # The quotes of this tag do not end: they are no longer heeded, so no later tag is sought to the end again.
            tag_of = _BARE_TAG
            m = tag_of.match(page, at)
        if m is None:
            # No tag: text, but an unfinished tag at the end of the page goes.
            unfinished = (mark.isascii() and mark.isalpha() or mark == "/") and at > last and page.find("<", at + 1) < 0
            yield page[pos : at if unfinished else at + 1], None
            pos = n if unfinished else at + 1
            continue
        if at > pos:
            yield page[pos:at], None
        pos = m.end()
        yield "", m
        tag = m[2].lower()
        if not m[1] and tag in RAW_TAGS and (tag in ("title", "textarea") or not m[3].rstrip().endswith("/")):
            end = _raw_end(tag).search(page, pos)
            pos = page.find(">", end.end()) + 1 if end and end.end() <= last else n


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


class _Open:
    """The stack of open elements, with what is asked of it at every tag kept up to date."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, int, int]] = []
        self.count: Counter[str] = Counter()

    @property
    def top(self) -> tuple[bool, bool]:
        """(bad, main) inside the innermost element."""
        return self.stack[-1][1:3] if self.stack else (False, False)

    def push(self, tag: str, bad: bool, main: bool) -> None:
        _, _, _, blocks, linked = self.stack[-1] if self.stack else ("", False, False, 0, -1)
        self.stack.append((tag, bad, main, blocks + (tag in BLOCK_TAGS and tag != "p"), len(self.stack) if tag in _LINKED or tag == "p" else linked))
        self.count[tag] += 1

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.count[self.stack.pop()[0]] -= 1

    def close(self, tag: str) -> bool:
        if not self.count[tag]:
            return False
        while self.stack[-1][0] != tag:
            self.cut(len(self.stack) - 1)
        self.cut(len(self.stack) - 1)
        return True

    def _chain(self) -> Iterator[tuple[int, str]]:
        """Open elements that an opening tag may close or that bound it, from the innermost on."""
        at = self.stack[-1][4] if self.stack else -1
        while at >= 0:
            yield at, self.stack[at][0]
            at = self.stack[at - 1][4] if at else -1

    def imply(self, tag: str) -> None:
        """Ends the paragraph that a block cannot stand in, and the item that the next one ends."""
        if self.count["p"]:
            k = next(i for i, t in self._chain() if t == "p" or t in _LINKED)
            if self.stack[k][0] == "p" and self.stack[-1][3] == self.stack[k][3]:
                self.cut(k)
        shut = _CLOSES.get(tag, ())
        for k, t in self._chain():
            if t in shut:
                self.cut(k)
                break
            if t in _BOUNDS:
                break


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with text white space collapsed and character references decoded."""
    out: list[Block] = []
    inside, pieces = _Open(), []
    linked, anchor, bad, main, heading = 0, False, False, False, False

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), bad, main, heading, inside.count["p"] > 0))
        pieces.clear()
        linked = 0

    for text, m in tokens(page):
        if m is None:
            pieces.append(text)
            if anchor:
                linked += len(text.strip())
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                anchor = False
            if tag in BLOCK_TAGS:
                flush()
                heading = False
            if inside.close(tag):
                bad, main = inside.top
            continue
        if tag in RAW_TAGS or tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            heading = tag in HEADINGS
            inside.imply(tag)
            if tag in MAIN_TAGS:
                # A menu or page header left open does not hold the article.
                while inside.top[0] and inside.count["nav"] + inside.count["header"]:
                    inside.cut(len(inside.stack) - 1)
            bad, main = inside.top
        if tag == "a":
            anchor = True
        if tag in VOID_TAGS or m[3].rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        inner_bad = bad or _cues(tag, m[3], main)
        inside.push(tag, inner_bad, (main or tag in MAIN_TAGS) and not inner_bad)
        if tag in BLOCK_TAGS or inner_bad != bad:
            if inner_bad != bad:
                flush()
            bad, main = inside.top
    flush()
    return out


def stop_density(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def decide(block: Block) -> str:
    """Pass 1: good, bad, near (middling) or short."""
    size, links = len(block.text), block.link_chars / len(block.text)
    if block.bad:
        return "bad"
    if size < LENGTH_LOW:
        kind = "bad" if block.link_chars else "short"
        if links <= LINKS_HIGH and block.main:
            kind = "short"
    elif links > LINKS_HIGH:
        kind = "bad"
    else:
        density = stop_density(block.text)
        kind = ("bad" if block.link_chars else "short") if density < STOP_LOW else "good" if density >= STOP_HIGH and size > LENGTH_HIGH else "near"
    if not block.main:
        return kind
    return {"bad": "short" if size < LENGTH_LOW else "near", "short": "near", "near": "good", "good": "good"}[kind]


def label(found: list[Block]) -> list[Block]:
    """Both passes over the blocks of a page."""
    first = [decide(b) for b in found]
    content = any(b.main and x in ("good", "near") for b, x in zip(found, first, strict=True))
    settled = [k for k, x in enumerate(first) if x in ("good", "bad") and not found[k].bad and not found[k].main]
    at = 0
    for k, kind in enumerate(first):
        found[k].label = kind
        if kind in ("good", "bad"):
            continue
        if found[k].main:
            found[k].label = "good" if kind == "near" or content else "bad"
            continue
        while at < len(settled) and settled[at] < k:
            at += 1
        left = settled[at - 1] if at else None
        right = settled[at] if at < len(settled) else None
        sides = {first[x] for x in (left, right) if x is not None}
        if found[k].heading and right is not None:
            found[k].label = first[right]
        elif len(sides) == 1 and (left is not None and right is not None or sides == {"good"}):
            found[k].label = sides.pop()
        elif kind == "near" or not sides and not content and (found[k].heading or found[k].paragraph):
            found[k].label = "good"
        elif sides == {"good", "bad"}:
            near = left if k - left < right - k else right if right - k < k - left else None
            found[k].label = first[near] if near is not None else "bad"
        else:
            found[k].label = "bad"
    return found


def extract(page: str | None) -> str:
    """The main text of a page, blocks joined by an empty line; empty for null or a page without one."""
    return "\n\n".join(b.text for b in label(blocks(page or "")) if b.label == "good")


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row; n_chars counts code points.

    A null or empty page has an empty text, ids and urls may be null, rows repeat as in the input, pages of any length are
    read whole, a block that is as near to a good as to a bad one is bad. Other columns, whatever their names, are not read;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kinds = [narrow.schema[c].dataType.simpleString() for c in ("id", "url")]
    return map_batches(narrow, run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_column, "url": url_column})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
