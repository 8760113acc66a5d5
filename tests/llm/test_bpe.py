import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


PIECES = ["abcde", "the ", "  ", "\n\n", "'s", "'", "123", "é", "日本", "😀", "...", "<|endoftext|>", "<|endo", "x" * 40, "ab" * 30, " " * 50, "!" * 37, "0" * 55, "\t", "'ll", "''''s", " <|"]


def test_random_texts_by_small_leaves(library):
    codec, rnd = bpe.Codec(PATH, leaf=16, window=4, run=16), random.Random(3)
    for _ in range(2000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25)))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False) == text
        parts = [(a, t, codec.encode(t) if a else codec.tree(t)) for a, t in codec.segments(text, 23)]
        assert codec.join_segments(parts) == want


_LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    codec = bpe.codec(PATH)
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode(text)
    assert ids == _LIBRARY.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == text


def test_columns_beside_the_tokens(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x", "y"), (2, "z" * 9000, 6, None, "y")], "doc_id bigint, text string, n_tokens int, id string, key string")
    out = bpe.encode_texts(df, PATH, segment=4000, with_columns=True)
    assert out.columns == ["doc_id", "id", "key", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id, r.id, r.key) for r in out.collect()) == [(1, "x", "y"), (2, None, "y")]


def test_long_unsplit_text(library):
    rnd = random.Random(4)
    for alphabet in ("ab", "abcdefgh", "!?", " ", "é日"):
        text = "".join(rnd.choice(alphabet) for _ in range(20_000))
        assert bpe.codec(PATH).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_table(spark, library):
    texts = [None, "", "a", "hello <|endoftext|> world", "word " * 3000, "z" * 9000, "word " * 3000]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(None, "null id", 5)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encode_texts(df, PATH, segment=4000, with_ids=True).collect()}
    assert len(got) == len(texts) + 1
    for k, t in [*enumerate(texts), (None, "null id")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[k]
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0
