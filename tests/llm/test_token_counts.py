import json
from itertools import accumulate
from unittest import mock

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import token_counts as tc

NAME = "byte_bpe_50k.json"
PIECES = ["a", "the ", "  ", "\n", "\t", "é", "漢", "<|endoftext|>", "'s", "12", "!!", " x", " ", "\x1c", "zz" * 9]


@pytest.fixture(scope="module")
def coder():
    pytest.importorskip("public_tokenizers")
    return tc.load(NAME)


@given(st.lists(st.sampled_from(PIECES), max_size=150), st.sampled_from([(16, 4), (40, 20), (64, 8)]))
@settings(max_examples=150, deadline=None)
def test_spliced_count_is_the_undivided_one(coder, pieces, sizes):
    text = "".join(pieces)
    assert tc.count_huge(coder.encode, text, *sizes)[0] == len(coder.encode(text, add_special_tokens=False))


def test_long_texts_without_boundaries(coder):
    for text in ("a" * 3000, " " * 3000, "é" * 999, "a " * 800):
        n, _, widened = tc.count_huge(coder.encode, text, 256, 16)
        assert n == len(coder.encode(text, add_special_tokens=False)) and widened


def test_rows(spark, coder):
    rows = [(1, "Hello <|endoftext|> world"), (2, None), (3, ""), (None, "x y"), (1, "Hello <|endoftext|> world"), (5, "word é " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as n_tokens", "1 as n_bytes")
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(df).collect()]
    assert got == [(i, len((t or "").encode()), (n := len(coder.encode(t or "", add_special_tokens=False))), n > 512) for i, t in rows]
    assert tc.token_counts(df).collect()[5].n_chunks > 1
    assert tc.token_counts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tc.token_counts(df, chunk=10, overlap=9)


def test_counts_beside_the_rows(spark):
    rows = [(1, "one two", 5), (None, None, 6), (2, "x " * 30_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more int")
    got = tc.with_token_counts(df)
    want = {r.doc_id: r.n_tokens for r in tc.token_counts(df).collect()}
    assert got.columns == ["doc_id", "text", "more", "n_tokens"]
    assert {(r.doc_id, r.more): r.n_tokens for r in got.collect()} == {(i, m): want[i] for i, _, m in rows}
    with pytest.raises(ValueError):
        tc.with_token_counts(got)


def test_other_tokenizers_are_rejected():
    with pytest.raises(ValueError, match="byte-level"):
        tc.load("word_bpe_49k.json")


class Watched:
    """A tokenizer that counts the characters it encodes."""

    def __init__(self, coder):
        self.coder, self.encode, self.chars = coder, coder.encode, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.chars += sum(map(len, texts))
        return self.coder.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_a_piece_is_encoded_once(coder, monkeypatch):
    watched = Watched(coder)
    monkeypatch.setitem(tc._loaded, "watched", watched)
    texts = ["some words that come again, again and <|endoftext|> again\n" * 40 + str(i) for i in range(50)]
    want = [len(e) for e in coder.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):
        assert tc.counted(pa.array(texts, pa.large_string()), "watched", tc.CHUNK, tc.OVERLAP)[0] == want
    assert watched.chars < len(texts[0])


def test_texts_of_new_words_are_encoded_whole(coder, monkeypatch):
    monkeypatch.setattr(tc, "COLD_CHARS", 100)
    held = tc._Held(coder)
    for k in range(4):
        texts = [" ".join(f"{k}x{i}y{j}" for j in range(50)) for i in range(5)]
        assert held.totals(texts) == [len(coder.encode(t, add_special_tokens=False)) for t in texts]
    assert held.chars < 3000


@given(st.lists(st.lists(st.sampled_from([*PIECES, "\r", "\xa0", " ", "᠎", "\x85", "_", "🙂", "é", "<|endof", "text|>"]), max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_end_at_proven_boundaries_and_their_counts_add_up(coder, lists):
    texts = ["".join(x) for x in lists]
    for text in texts:
        pieces = tc._PIECE.findall(text)
        assert "".join(pieces) == text
        starts = list(accumulate(map(len, pieces)))
        assert [a for a in starts if a < len(text)] == [a for a in range(1, len(text)) if tc._stable(text, a)]
    held = tc._Held(coder)
    with mock.patch.object(tc, "HELD_CHARS", 20), mock.patch.object(tc, "_BATCH_PIECES", 3), mock.patch.object(tc, "COLD_CHARS", 10):
        for text in texts:
            assert held.totals([text]) == [len(coder.encode(text, add_special_tokens=False))]


def test_added_tokens_that_look_at_white_space_are_rejected(coder, tmp_path):
    spec = json.loads(coder.to_str())
    spec["added_tokens"][0]["rstrip"] = True
    path = tmp_path / "strip.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="white space"):
        tc.load(str(path))
