from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.operators import merging as M
from foliant.operators.chunking import Chunker, pack_entries, weighted_tokens

TEXTS = st.lists(st.sampled_from(["Word one two.", "", "and so", "Chapter 3", "x" * 60, "她说：你好。", '"Go. Now," he said.', "  ", "a, b, c,"]), max_size=30).map("\n".join)


def test_headings_join_with_front_matter():
    text = "intro line\nChương 1\nfirst body\nChương 2\nsecond body"
    chunker = Chunker(100, len)
    assert [t for t, _ in chunker.chapters(text)] == ["Intro", "Chương 1", "Chương 2"]
    assert [p.kind for p in Chunker(100, len, balance=False).hybrid(text)] == ["hybrid_chapter_merge", "hybrid_chapter_full"]
    assert len(chunker.hybrid(text)) == 1


def test_overlong_chapter_is_cut():
    pieces = Chunker(100, len).hybrid("X" * 150)
    assert [(p.kind, p.tokens) for p in pieces] == [("paragraph_split", 100), ("paragraph_split", 50)]


def test_incomplete_paragraph_may_overflow():
    chunker = Chunker(40, len)
    whole, cut, tail = "A sentence that is whole and long now.", "and it goes on,", "short end"
    assert len(chunker.pack("\n\n".join([whole, tail]))) == 1
    assert len(chunker.pack("\n\n".join([whole, tail + "."]))) == 2
    assert len(chunker.pack("\n\n".join([whole, cut + " too long a tail"]))) == 2


def test_sentences_know_speech():
    assert Chunker.sentences('He said "Stop. Now." Then left. v.v. end') == ['He said "Stop. Now." Then left.', "v.v.", "end"]
    assert Chunker.sentences("don't stop. Go on") == ["don't stop. Go on"]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(5, 60))
def test_packing_keeps_content_and_limits(text, limit):
    chunker = Chunker(limit)
    pieces = chunker.pack(text)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(p.text for p in pieces)) == squeeze(text)
    for p in chunker.cap(pieces):
        parts = [x for x in p.text.split("\n") if x.strip()]
        assert p.tokens <= limit * 1.5 + 3 or len(parts) > 1
    assert squeeze("".join(p.text for p in chunker.hybrid(text))) == squeeze(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(1, 30))
def test_hard_split(text, limit):
    parts = Chunker(limit).hard_split(text)
    assert all(weighted_tokens(p) <= limit or len(p) == 1 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_entries_fill_up_to_the_limit():
    assert pack_entries([11, 11, 11], 25) == [1, 1, 2]
    assert pack_entries([30, 5, 20, 3], 10) == [1, 2, 3, 4]
    assert pack_entries([], 10) == []


def test_block_sections():
    chunks = Chunker(100, len).by_blocks([("paragraph", "a" * 50), ("heading", "H"), ("paragraph", "b" * 500), ("paragraph", " ")])
    assert chunks[0].text == "a" * 50 and all(c.tokens <= 100 for c in chunks) and len(chunks) == 7


def test_token_weights():
    assert weighted_tokens("") == 0 and weighted_tokens("a") == 1
    assert weighted_tokens("你好世界") == 4 and weighted_tokens("abcd efgh!") == (4 * 0 + 1 + 2 + 8) // 4


def test_overlap_and_markers():
    assert M.merge_without_overlap(["One two three. Four five six.", "Four five six. Seven eight."]) == "One two three. Four five six.\n\nSeven eight."
    assert M.merge_without_overlap(["a b c.", "", "d e f."]) == "a b c.\n\nd e f."
    assert M.marker_problem("x", 1) is None and M.marker_problem("[CHUNK:1:START]x", 1) == "start 1, end 0"
    assert M.repair_markers("[CHUNK:1:START]a[CHUNK:1:START]b[CHUNK:1:END]c[CHUNK:1:END]", 1) == "[CHUNK:1:START]abc[CHUNK:1:END]"
    assert M.merge_paragraphs(["It went", "on. Then", "Next one."]) == "It went on. Then\n\nNext one."
    assert M.rejoin_lines("It was a\nlong day.\nThen night") == "It was a long day.\nThen night"
    assert all(len(p) <= 20 for p in M.wrap_words("A short one. Another rather longer sentence here. x" + "y" * 50, 20))
