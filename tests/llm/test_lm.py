import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import lm
from lexloom.llm.mapped import EliasFano, Held, Shelf, get_bits, every_byte, put_bits


@pytest.mark.parametrize(("size", "top"), [(0, 1), (1, 1), (1, 10**12), (5, 3), (1000, 10), (1000, 10**6), (50_000, 10**13), (20_000, 30_000)])
def test_elias_fano(size, top):
    rng = np.random.default_rng(size)
    values = np.sort(rng.integers(0, top, size)).astype(np.uint64)
    own = EliasFano(EliasFano.build(values, "x"), "x")
    at = np.arange(size)
    assert (own.access(at) == values).all()
    if size > 1:
        assert (own.after(at[:-1], own.select(at[:-1], True)) == values[1:]).all()
    asked = np.append(rng.integers(0, top + 5, 3000).astype(np.uint64), values[:500])
    spot, equal = own.successor(asked)
    expected = np.searchsorted(values, asked)
    assert (spot == expected).all() and (equal == ((expected < size) & (np.append(values, 0)[expected] == asked))).all()


def test_bits_and_files(tmp_path):
    values = np.random.default_rng(2).integers(0, 2**21, 1000).astype(np.uint64)
    assert (get_bits(every_byte(put_bits(values, 21)), np.arange(1000), 21) == values).all()
    for uri in (f"file://{tmp_path}/shelf", f"{tmp_path}/shelf"):
        shelf = Shelf(uri)
        shelf.put("a", {"x": values, "y": np.zeros(0, np.uint8), "z": np.array([7], np.uint16)})
        back = shelf.get("a")
        assert (back["x"] == values).all() and len(back["y"]) == 0 and back["z"][0] == 7 and shelf.names() == ["a"]


def test_bundles_of_a_store_that_is_not_mounted_stay_within_a_bound(tmp_path):
    shelf = Shelf(f"{tmp_path}/shelf")
    for n in range(6):
        shelf.put(f"b{n}", {"x": np.full(1000, n, np.int64)})
    mounted = Held(shelf, lambda raw: raw["x"])
    assert mounted["none"] is None and [mounted[f"b{n}"][0] for n in range(6)] == list(range(6)) and mounted.size == 0
    far = Shelf(f"{tmp_path}/shelf")
    far.path = None  # as any other store
    far._store = lambda: (__import__("pyarrow.fs").fs.LocalFileSystem(), f"{tmp_path}/shelf")
    held = Held(far, lambda raw: raw["x"])
    held.MOST = 20_000
    assert [held[f"b{n % 6}"][5] for n in range(20)] == [n % 6 for n in range(20)] and len(held.ready) == 2 and held.size == 16_000


def plain_scores(rows, order, discount):
    """By dictionaries, straight from the definition."""
    tokens = lambda t: (t or "").encode().lower().split()
    grams = [Counter() for _ in range(order + 1)]
    training = [t for n, t in rows if n is None or zlib.crc32(str(n).encode()) % 10]
    for t in training:
        words = [b"<", *tokens(t), b">"]
        grams[1].update(words[1:])
        for k in range(2, order + 1):
            grams[k].update(zip(*(words[i:] for i in range(k)), strict=False))
    total, types = sum(grams[1].values()), len(grams[1])
    context = [Counter() for _ in grams]
    kinds = [Counter() for _ in grams]
    for k in range(2, order + 1):
        for gram, count in grams[k].items():
            context[k][gram[:-1]] += count
            kinds[k][gram[:-1]] += 1
    out = []
    for _, t in rows:
        words = [b"<", *tokens(t), b">"]
        base = own = 0.0
        for i in range(1, len(words)):
            p = (grams[1][words[i]] + 0.1) / (total + 0.1 * (types + 1))
            base += math.log10(p)
            for k in range(2, min(order, i + 1) + 1):
                before = tuple(words[i - k + 1 : i])
                if context[k][before]:
                    p = max(grams[k][(*before, words[i])] - discount, 0) / context[k][before] + discount * kinds[k][before] / context[k][before] * p
            own += math.log10(p)
        out.append((len(words) - 1, sum(grams[1][w] > 0 for w in words[1:]), base, own))
    return out, total


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_the_definition(spark, docs, rows, order):
    pairs = [(n, t) for n, t, *_ in rows]
    expected, total = plain_scores(pairs, order, 0.75)
    frame = docs.select("doc_id", "text")
    out = lm.train_and_score(frame, lm.held_out(frame["doc_id"]), order=order).collect()
    key = lambda x: (x[0], round(x[2], 6), round(x[3], 1))
    mine = sorted(((r.n_tokens, r.n_known, r.base_score, r.score) for r in out), key=key)
    for a, b in zip(mine, sorted(expected, key=key), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-6) and abs(a[3] - b[3]) <= 1e-3 * max(1, a[0])
    assert {r.train_tokens for r in out} == {total}


def test_model_beats_its_base_on_held_out_text(spark):
    out = lm.op8_elias_fano_lm(spark, "/root/testdata/sf0.001").collect()
    held = [r for r in out if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def model(spark, rows, order, tmp_path, shards=8):
    """A stored model of all rows: (vocabulary, trie, the unigram probability of a count)."""
    uri = f"file://{tmp_path}/model"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    types, words = lm.build_vocabulary(lm.word_counts(docs, shards), uri, shards)
    often = lm.frequent(spark, uri, shards, words, len(rows))
    lm.build_tries(lm.ngram_counts(docs, uri, shards, len(often), order), uri, shards, often, 0.75, f"file://{tmp_path}/work")
    total = words + len(rows)
    return lm.Vocabulary(uri, shards), lm.Trie(uri, shards, order), lambda c: (c + 0.1) / (total + 0.1 * (types + 2)), often


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(spark, tmp_path, order):
    rows = [(1, "a b a c a b b"), (2, "b a"), (3, "a a b c c d"), (4, None), (5, " ".join(f"w{i % 97} x" for i in range(3000)))]
    vocabulary, trie, alone_of, often = model(spark, rows, order, tmp_path)
    words = sorted({w for _, t in rows for w in (t or "").encode().split()}) + [b"never"]
    for before in (b"", b"a", b"b a", b"a b", b"c", b"x w5", b"w5 x", b"never", b"never a"):
        texts = [before + b" " + w for w in words]
        ids, counts, place, first = lm.stream(texts, vocabulary)
        counts[ids == lm.END] = len(rows)
        p = lm.probabilities(ids, place, alone_of(counts), trie)
        last = np.append(first[1:], len(ids)) - 2  # each text's own word, before its end
        ids, counts, place, _ = lm.stream([before], vocabulary)
        counts[ids == lm.END] = len(rows)
        end = lm.probabilities(ids, place, alone_of(counts), trie)[-1]
        assert abs(p[last].sum() + end - 1) < 2e-3, before


def test_frequent_words_are_dealt_by_their_second_word(spark, tmp_path):
    rows = [(i, " ".join(f"the w{(i * 7 + j * j) % 500}" for j in range(40))) for i in range(60)]
    vocabulary, trie, _, often = model(spark, rows, 3, tmp_path)
    (the,), (count,) = vocabulary(lm.word_hashes([b"the"])[0])
    assert lm.FIRST_WORD <= the < len(often) and often[the] == count == 2400 and often[lm.START] == 60
    ids, counts, place, _ = lm.stream([t.encode() for _, t in rows], vocabulary)
    after = np.unique(ids[1:][ids[:-1] == the])
    homes = np.bincount(lm.home_of(np.full(len(after), the), after, len(often), 8), minlength=8)
    assert homes.min() > 0 and homes.max() < 2 * homes.mean()


def test_words_are_told_apart():
    rnd = np.random.default_rng(5)
    words = sorted({bytes(rnd.integers(1, 5, n).astype(np.uint8) + 64) for n in range(1, 40) for _ in range(300)} | {b"a", b"a\0", b"a\0\0", b"\0", b"\0" * 8, b"\0" * 9, b"\0" * 16, b"\0" * 17})
    hashed, number = lm.word_hashes([b" ".join(words), b"", b"\x0b\x0c", b"A b\tA"])
    assert number.tolist() == [len({*words}), 0, 0, 3]
    lowered = {w.lower() for w in words}
    assert len(set(hashed[: len(words)].tolist())) == len(lowered)
    alone = [lm.word_hashes([w])[0][0] for w in words]
    assert (np.array(alone) == hashed[: len(words)]).all()  # what stands around a word doesn't count
    assert hashed[-3] == hashed[-1] == lm.word_hashes([b"a"])[0][0]


def test_nothing_to_learn(spark, no_docs):
    assert lm.train_and_score(no_docs.select("doc_id", "text"), lm.held_out(no_docs["doc_id"])).count() == 0
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    out = lm.train_and_score(frame, frame["doc_id"] > 0).collect()
    assert [r.score for r in out] == [0.0, 0.0] and {r.train_tokens for r in out} == {0}
