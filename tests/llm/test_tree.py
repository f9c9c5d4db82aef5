"""Tree concatenation of whole texts: cuts at every place of hostile texts, and that long texts are joined."""

import public_tokenizers as P
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from seatwise.llm import bpe

SF = "/root/testdata/sf0.001"
BITS = ["the", "don't", "I'll", "'s", "'", "é", "́", "é", "Å", " ", "  ", "\n", "\t", " ", "　", " ", ".", "...", "_", "<|endoftext|>", "<|startoftext|>", "<|end",
        "12", "½", "x" * 30, "日本語", "\U0001f600", "İ", "ﬁ", "\x00", "\x85", "‍"]


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(P.path("word_bpe_49k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40).map("".join), st.integers(1, 40))
@example("<|endoftext|>" * 20, 1)
@example("a" * 300 + " " * 300 + "é" * 100, 7)
def test_joined_halves_are_the_whole_encoding(coder, text, leaf):
    want = coder.whole.encode(text, add_special_tokens=False).ids
    assert coder.encode([text], leaf) == [(" ".join(map(str, want)), coder.whole.decode(want, skip_special_tokens=False))]


def test_a_cut_at_every_place(coder):
    text = "It's é́ <|endoftext|>don't Å <|start  \n cafés12½..."
    want = coder.whole.encode(text, add_special_tokens=False).ids
    coder.encode([text])  # enters the special tokens
    for middle in range(len(text) + 1):
        units = coder._join_text(text, 0, middle, len(text), coder.units(text[:middle]), coder.units(text[middle:]))
        coder.learn({u for u in units if u[0] != "\1"})
        assert [int(i) for u in units for i in coder.ids[u].split()] == want


def test_every_long_text_is_joined(coder):
    texts = ["word " * 5000, "x" * 9000, "short", "", "日本 " * 4000]
    before = coder.joins
    out = coder.encode(texts)
    leaves = [1 << (max(1, -(-len(x) // bpe.TEXT_LEAF)) - 1).bit_length() for x in texts]
    assert coder.joins - before == sum(n - 1 for n in leaves) > 0
    for text, (ids, _) in zip(texts, out, strict=True):
        assert [*map(int, ids.split())] == coder.whole.encode(text, add_special_tokens=False).ids


def test_long_texts_of_the_table(coder, spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = [x for x in texts if x and len(x) > bpe.TEXT_LEAF]
    before = coder.joins
    out = coder.encode(long)
    assert long and coder.joins - before >= len(long)
    assert [[*map(int, ids.split())] for ids, _ in out] == [coder.whole.encode(x, add_special_tokens=False).ids for x in long]
