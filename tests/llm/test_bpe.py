import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import bpe, packing
from lexloom.llm.common import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
PIECES = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'l", "'ll", " 's", "don't", "I'VE", "a", "Z", "é", "中文", "١٢", "½", "🙂", "<|endoftext|>", "\xa0", " ", "\r\n", "--", "12", "_", "́", "aaaa", "x'd", "\x85", "\x1c", "　"]


@pytest.fixture(scope="module")
def both():
    path = tokenizer_file("byte_bpe_50k.json")
    return bpe.ByteBpe(path), tokenizers.Tokenizer.from_file(path)


def same(both, texts):
    mine, library = both
    ids = mine.encode([t.encode() for t in texts])
    for text, own, known in zip(texts, ids, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own == known.ids, text[:80]
        assert mine.decode(own) == library.decode(own, skip_special_tokens=False)


def test_odd_mixtures(both):
    rnd = random.Random(1)
    same(both, ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(3000)])


def test_long_runs(both):
    same(both, ["a" * 5000, "=" * 3000, "ab" * 2000, " " * 2000, "\n" * 700, "9" * 3000, "é" * 900, ""])


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(both, text):
    text = text.encode("utf-8", "replace").decode()
    same(both, [text])


def test_any_ids_decode_alike(both):
    rnd = random.Random(2)
    mine, library = both
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(rnd.randrange(20))]
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_cut_as_the_library_cuts_it(both):
    """Beside a letter, a number, a space and another character."""
    mine, library = both
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 30_000):
        text = "".join(f"x{c}1{c}!{c} {c}" for c in map(chr, codes[at : at + 30_000]))
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        fresh = np.zeros(len(code), bool)
        fresh[0] = True
        starts = np.flatnonzero(mine.word_starts(code, fresh))
        known = np.array([a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(text)])
        assert len(starts) == len(known) and (starts == known).all(), hex(codes[at])


def test_memory_of_words_is_bounded_by_bytes(both):
    mine, _ = both
    mine.forget()
    for i in range(40):
        mine.encode([f"{i}{'ab' * 300_000}".encode()])
        assert mine.held <= bpe.REMEMBERED + 700_000 and sum(len(w) + bpe.ENTRY for w in mine.seen) == mine.held
    mine.forget()


def test_forgetting_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    same(both, [f"word{i} other{i % 7}" for i in range(50)])
    same(both, [f"word{i} other{i % 7}" for i in range(50)])


def test_query(spark, folder, no_docs, docs, rows, both):
    out = bpe.op9_bpe(spark, folder).collect()
    expected = []
    for number, text, *_ in rows:
        ids = both[1].encode(text or "", add_special_tokens=False).ids
        expected.append((number is None, number or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(expected)
    assert bpe.round_trip(no_docs).count() == 0
    assert bpe.token_ids(docs).filter("doc_id = 4").first().ids == both[1].encode("one two three").ids


def test_packing_tokenizer_agrees(both):
    encoding = packing.tokenizer("byte_bpe_50k.json")
    rnd = random.Random(4)
    for _ in range(500):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40)))
        assert encoding.encode(text, allowed_special="all", disallowed_special=()) == both[1].encode(text, add_special_tokens=False).ids
