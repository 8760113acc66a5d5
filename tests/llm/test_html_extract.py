import re
import time
from html.parser import HTMLParser

import pytest

from foliant.llm.html_extract import blocks, extract, extract_pages, label

LONG = "This is the story of a town that was built on the river and of the people who lived in it for many years. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words", ""),
        ("<article><h1>A &amp; B</h1><p>one<br>two<p>three &lt;x&gt;&nbsp; y</article>", "A & B\n\none two\n\nthree <x> y"),
        ("<nav><a>x</a></nav><article><header><h1>T</h1></header><p>a<!-- no --><script>if(a<b){'</p>'}</script></p><aside>s</aside><footer>f</footer></article>", "T\n\na"),
        ("<article><p>a</p><div class='ad-box'>buy</div><form><p>mail</p></form><div id=comments><p>nice</p></div><p>b</p></article>", "a\n\nb"),
        ("<article><p>a</p><section class='comments'><article class=comment>c</article></section></article><footer>&copy;</footer>", "a"),
        ("<article><p>cut off <a href='x", "cut off"),
        ("<article><p>a &am", "a &am"),
        ("<nav><ul><li>left open<article><p>body</p></article>", "body"),
        ("<article><p hidden>h</p><p style='display:none'>n</p><p>shown</p><div role=dialog>cookie</div></article>", "shown"),
        ("<style>p{}</style><title>t</title><main><p>x</p><textarea>y</textarea></main>", "x"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        (f"<div><a href=a>Home</a> <a>News</a></div><h2>Title</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div><a>more</a></div>", f"Title\n\n{LONG.strip()}\n\nShort one.\n\n{LONG.strip()}"),
        (f"<div class=sidebar><p>{LONG}</p></div><p>{LONG}</p>", LONG.strip()),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


def test_short_blocks_follow_the_nearest_neighbour():
    page = f"<p>{LONG}</p><p>near the text</p><p><a>one link</a></p><p>near the links</p><p><a>two</a></p>"
    kinds = [b.label for b in label(blocks(page))]
    assert kinds[0] == "good" and kinds[3] == "bad"


def test_table(spark):
    rows = [(1, "u", None, "x"), (None, None, "<article><p>é</p></article>", "x"), (2, "u", "<article>" + "<p>w</p>" * 20_000 + "</article>", "x"), (2, "u", "", "x")]
    got = [(r.page_id, r.url, r.text[:3], r.n_chars) for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "", 0), (None, None, "é", 1), (2, "u", "w\n\n", 20_000 * 3 - 2), (2, "u", "", 0)], key=str)
    assert extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_main_text_beside_a_teaser_article():
    teaser = "<article class=card><h3><a href=x>Another story</a></h3><p>Read on.</p></article>"
    got = extract(f"<div><a href=a>Home</a></div><div><p>{LONG}</p><p>{LONG}</p></div>{teaser}<div><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>")
    assert got.count(LONG.strip()) == 3


def test_paragraphs_of_links_in_an_article_stay():
    linked = "<a href=x>the report of the year and the list of all that was in it</a> is here for you"
    cited = "<a href=y>Kessler, Brandt, Olsen: Granite quarries, railway sidings, harbour cranes, 1931</a>"
    got = extract(f"<article><p>{LONG}</p><p>{linked}</p><p>{cited}</p><p><a href=z>full text</a></p></article>")
    assert "the list of all" in got and "Granite quarries" in got and "full text" in got
    assert extract("<article class=card><a href=x>more</a></article><p>" + LONG + "</p>") == LONG.strip()


def _renamed(page):
    return re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", page or "")


class Plain(HTMLParser):
    """Blocks of the article, found another way: a tree walk over what the standard parser reports."""

    BAD = {"nav", "header", "footer", "aside", "form", "script", "style", "title", "noscript", "button", "select", "head"}
    VOID = {"br", "img", "hr", "input", "meta", "link", "wbr"}
    BLOCK = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "th", "pre", "blockquote", "body", "html", "head"}

    def __init__(self):
        super().__init__()
        self.open, self.found, self.held = [], [], []

    def cut(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.found.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.cut()
            if any(t == "p" for t, _ in self.open):
                while self.open.pop()[0] != "p":
                    pass
        names = set(" ".join(v or "" for k, v in attrs if k in ("class", "id")).split())
        bad = tag in self.BAD or bool(names & {"ad", "ads", "sidebar", "comment", "comments", "cookie", "notice", "menu", "related", "share", "footer", "header", "nav"}) or any(k == "hidden" for k, _ in attrs)
        if tag == "br":
            self.held.append(" ")
        if tag not in self.VOID:
            self.open.append((tag, bad))

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.cut()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.open) and not any(b for _, b in self.open):
            self.held.append(data)


def test_against_a_tree_walk():
    import pyarrow.parquet as pq

    from tests.compare import SMALL

    pages = pq.read_table(f"{SMALL}/pages.parquet").column("html").to_pylist()
    for page in pages:
        tree = Plain()
        tree.feed(page or "")
        tree.close()
        tree.cut()
        assert extract(page).split("\n\n") == (tree.found or [""])


def test_the_rules_alone_find_the_same_text():
    import pyarrow.parquet as pq

    from tests.compare import SMALL

    pages = pq.read_table(f"{SMALL}/pages.parquet").column("html").to_pylist()
    same = [extract(_renamed(p)) == extract(p) for p in pages]
    assert sum(same) >= 0.98 * len(same)


@pytest.mark.parametrize("part", ["<a ", "<div>x", "<b>", "<b></i>", "<b><li>x</li>", '<a "', "<p><b>", "<script></script ", "<", "<td><li>", "&amp"])
def test_time_grows_with_the_length(part):
    began = time.process_time()
    extract(part * (300_000 // len(part)) + ">")
    assert time.process_time() - began < 4
    if part == "<a ":
        began = time.process_time()
        extract(part * 350_000)
        assert time.process_time() - began < 1
