from foliant.functions import layout as L


def test_text_map_and_nesting():
    entries, page = L.text_map('<h1>T</h1><p><img src="a.png"></p><p>one <b>two</b> &amp; x</p><div><p>in</p></div><p></p>', "c1")
    assert [(e.text_id, e.text, e.image_only) for e in entries] == [("c1-0000", "T", False), ("c1-0001", "", True), ("c1-0002", "one two & x", False), ("c1-0003", "in", False), ("c1-0004", "in", False)]
    assert 'data-nt-image-only="true"' in page and '<b>two</b>' in page
    nested, _ = L.text_map("<p>a<p>b</p></p>", "c")
    assert [e.text for e in nested] == ["a b", "b"]


def test_reinjection_keeps_structure():
    page = '<p data-ntid="a"><strong class="x">old</strong></p><p data-ntid="b"><em>x</em> <b>y</b></p><td data-ntid="c" style="s"><p><strong>old</strong></p></td><p data-ntid="d">t<img src="i.png"></p><p data-ntid="e" data-nt-image-only="true"><img src="j.png"></p>'
    out = L.reinject(page, {"a": "new", "b": "plain", "c": "cell", "d": "T < U", "e": "no"})
    assert '<strong class="x">new</strong>' in out
    assert '<p data-ntid="b">plain</p>' in out
    assert '<td data-ntid="c" style="s"><p><strong>cell</strong></p></td>' in out
    assert '<p data-ntid="d">T &lt; U<img src="i.png"/></p>' in out
    assert '<img src="j.png"/>' in out and "no" not in out
    assert L.reinject("<p>x</p>", {}) == "<p>x</p>"


def test_lines_without_blocks_are_regrouped():
    assert L.epub_paragraphs("<nav>menu</nav>short<br>" + "w" * 60) == ["short", "w" * 60]
    assert L.epub_paragraphs("<p>a</p><script>x</script><p>b</p>") == ["a", "b"]


def test_pages_nest_to_any_depth():
    page = "<p>x <b>y</b>" * 3000
    entries, marked = L.text_map(page, "c")
    assert len(entries) == 3000 and entries[-1].text == "x y" and entries[-2].text == "x y x y" and entries[-2].inner == "x <b>y</b><p>x <b>y</b></p>"
    assert marked.endswith("</p>" * 3000) and marked.count("data-ntid") == 3000
    assert L.reinject(marked, {entries[-1].text_id: "new"}).count("<b>y</b>") == 2999
    assert len(L.epub_paragraphs(page)) == 3000
