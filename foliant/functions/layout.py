"""HTML with stable text ids: a text map of a chapter's blocks, and translations put back into it.

A small tree is built with the standard parser. Blocks nest as written (a p inside a p is a child of it),
which decides what text each block holds.
"""

from __future__ import annotations

import html
from dataclasses import dataclass, field
from html.parser import HTMLParser

BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote div td th".split())
INLINE = frozenset("strong em b i a span sub sup u s small mark".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAX_WRAPPERS = 5


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self):
        """All nodes below, in the order of the page; like the other passes without recursion, as pages nest to any depth."""
        todo = self.tags()[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.tags()[::-1]

    def tags(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def pieces(self):
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, Node):
                todo += c.children[::-1]
            else:
                yield c

    def text(self, sep: str = " ") -> str:
        return sep.join(s for p in self.pieces() if (s := html.unescape(p).strip()))

    def head(self) -> str:
        attrs = "".join(f" {k}" if v is None else f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}/>" if self.tag in VOID else f"<{self.tag}{attrs}>"

    def inner(self) -> str:
        out: list[str] = []
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
                continue
            out.append(c.head())
            if c.tag not in VOID:
                todo.append(f"</{c.tag}>")
                todo += c.children[::-1]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].children.append(data)

    def handle_entityref(self, name):
        self.open[-1].children.append(f"&{name};")

    def handle_charref(self, name):
        self.open[-1].children.append(f"&#{name};")


def parse(page: str) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


@dataclass
class Entry:
    """A block of a page; its text and HTML are cut out of the page's when asked for, as nested blocks share them."""

    text_id: str
    chapter_id: str
    order: int
    image_only: bool
    span: _Span
    texts: list[str]
    page: str

    @property
    def text(self) -> str:
        return " ".join(self.texts[self.span.first : self.span.last])

    @property
    def inner(self) -> str:
        return self.page[self.span.start : self.span.end]


@dataclass
class _Span:
    """A node's part of the page's texts, of its HTML and of the images counted so far."""

    node: Node
    first: int
    start: int
    image: int
    last: int = 0
    end: int = 0
    images: int = 0


def _spans(root: Node) -> tuple[list[_Span], list[str], str]:
    """Spans of all nodes in the order of the page, its texts and its HTML."""
    spans: list[_Span] = []
    texts: list[str] = []
    out: list[str] = []
    at = images = 0
    todo: list[Node | str | _Span] = list(root.children[::-1])
    while todo:
        c = todo.pop()
        if isinstance(c, _Span):
            c.last, c.end, c.images = len(texts), at, images
            piece = "" if c.node.tag in VOID else f"</{c.node.tag}>"
        elif isinstance(c, str):
            piece = c
            if s := html.unescape(c).strip():
                texts.append(s)
        else:
            piece = c.head()
            images += c.tag == "img"
            spans.append(_Span(c, len(texts), at + len(piece), images))
            todo += [spans[-1], *(() if c.tag in VOID else c.children[::-1])]
        out.append(piece)
        at += len(piece)
    return spans, texts, "".join(out)


def text_map(page: str, chapter: str) -> tuple[list[Entry], str]:
    """Blocks with text, or with an image only, in order; and the page with their ids."""
    root, out = parse(page), []
    spans, texts, plain = _spans(root)
    for span in spans:
        image_only = span.first == span.last
        if span.node.tag not in BLOCKS or image_only and span.image == span.images:
            continue
        entry = Entry(f"{chapter}-{len(out):04d}", chapter, len(out), image_only, span, texts, plain)
        span.node.attrs["data-ntid"] = entry.text_id
        if image_only:
            span.node.attrs["data-nt-image-only"] = "true"
        out.append(entry)
    return out, root.inner()


def _wrappers(tags: list[Node]) -> list[tuple[str, dict]]:
    chain: list[tuple[str, dict]] = []
    while len(tags) == 1 and len(chain) < MAX_WRAPPERS:
        kept = {k: v for k, v in tags[0].attrs.items() if k not in ("data-ntid", "data-nt-image-only")}
        chain.append((tags[0].tag, kept))
        tags = tags[0].tags()
    return chain


def reinject(page: str, translations: dict[str, str]) -> str:
    """The page with the text of blocks replaced: images stay, a single inline child or a table cell's chain of
    single children still wraps the text, anything else becomes plain text."""
    root = parse(page)
    for node in list(root.walk()):
        new = translations.get(node.attrs.get("data-ntid") or "")
        if new is None or node.attrs.get("data-nt-image-only") == "true":
            continue
        images = [n for n in node.walk() if n.tag == "img"]
        tags = [t for t in node.tags() if t.tag != "img"]
        body: Node | str = html.escape(new, quote=False)
        if node.tag in ("td", "th"):
            chain = _wrappers(tags)
        else:
            chain = [(tags[0].tag, tags[0].attrs)] if len(tags) == 1 and tags[0].tag in INLINE else []
        for tag, attrs in reversed(chain):
            body = Node(tag, dict(attrs), [body])
        node.children = [body, *images]
    return root.inner()


def epub_paragraphs(page: str) -> list[str]:
    """Text of a chapter's blocks in order; without blocks, lines regrouped (one under 50 characters joins the line before)."""
    root = parse(page)

    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in ("script", "style", "nav")]
        todo += node.tags()
    spans, texts, _ = _spans(root)
    found = [s for s in spans if s.node.tag in BLOCKS - {"td", "th"}]
    if found:
        return [" ".join(texts[s.first : s.last]) for s in found if s.first < s.last]
    out: list[str] = []
    for line in root.text("\n").split("\n"):
        line = line.strip()
        if out and line and len(line) < 50:
            out[-1] += " " + line
        elif line:
            out.append(line)
    return out
