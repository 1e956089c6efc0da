import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import tokencount
from lexloom.llm.common import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
PARTS = [" ", "  ", "▁", "the", "ing", "é", "☃", "🙂", "\n", "\t", "a", "aa", "in", "<s>", "<0x41>", "<unk>", "0", "12", "中", "ﬁ", "e", "s", ".", "zq"]


@pytest.fixture(scope="module")
def both():
    pieces = tokencount.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return tokencount.PieceCounter(pieces), library


def same(both, texts):
    for text, known in zip(texts, both[1].encode_batch(texts, add_special_tokens=False), strict=True):
        assert both[0].text(text) == len(known.ids), repr(text)


def test_mixtures(both):
    rnd = random.Random(6)
    same(both, ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(25))) for _ in range(3000)] + ["", "x" * 5000, "☃" * 300, " " * 50])


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(both, text):
    same(both, [text.encode("utf-8", "replace").decode()])


def test_ties_go_to_the_earliest_start():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("c", -1.0), ("bc", -3.0), ("abc", -5.0)]
    own = tokencount.PieceCounter(pieces)
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rnd = random.Random(7)
    for _ in range(500):
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(12)))
        assert own.text(text) == len(library.encode(text).ids), text


def test_query(spark, folder, rows, no_docs, both):
    out = tokencount.op2_viterbi_counts(spark, folder).collect()
    expected = sorted((n is None, n or 0, len(t or ""), len(both[1].encode(t or "").ids)) for n, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.n_tokens) for r in out) == expected
    assert tokencount.counted(no_docs).count() == 0
