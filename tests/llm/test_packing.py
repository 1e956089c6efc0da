import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import packing
from lexloom.llm.common import keep, shared_dir, tokenizer_file

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    gaps: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gap = min(fits)
            gaps.remove(gap)
        else:
            gap = capacity
        gaps.append(gap - length)
    return len(gaps)


def check(out: list, capacity: int = packing.CAPACITY) -> None:
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def packed(spark, lengths: list[int], capacity: int) -> list:
    rows = spark.createDataFrame([(i, 0, 0, x, i) for i, x in enumerate(lengths)], packing.PIECES).repartition(3)
    folder = shared_dir(spark)
    out = packing.packed(keep(rows.withColumn("item", F.monotonically_increasing_id()), folder, "pieces"), folder, capacity).collect()
    assert Counter((r.doc_id, r.length) for r in out) == Counter(enumerate(lengths))
    check(out, capacity)
    return out


CASES = {
    "uniform": lambda rnd: [rnd.randrange(1, 101) for _ in range(400)],
    "small": lambda rnd: [rnd.randrange(1, 9) for _ in range(300)],
    "large": lambda rnd: [rnd.randrange(40, 101) for _ in range(200)],
    "one": lambda rnd: [1] * 250,
    "two kinds": lambda rnd: [60] * 40 + [13] * 90 + [100] * 5,
    "full": lambda rnd: [100] * 7,
    "single": lambda rnd: [51],
}


@pytest.mark.parametrize("name", CASES)
def test_as_few_sequences_as_best_fit_decreasing(spark, name):
    lengths = CASES[name](random.Random(name))
    used = len({r.sequence_id for r in packed(spark, lengths, 100)})
    assert used <= best_fit_decreasing(lengths, 100) * 1.02 + 1


def test_a_sweep_is_best_fit_by_rank(spark):
    """The pairs of one sweep, against a stack."""
    rnd = random.Random(4)
    for _ in range(3):
        docs, gaps = [rnd.randrange(1, 30) for _ in range(40)], [rnd.randrange(1, 40) for _ in range(30)]
        stack, pairs = [], Counter()
        for size, gap in sorted([(d, False) for d in docs] + [(g, True) for g in gaps]):
            if not gap:
                stack.append(size)
            elif stack:
                pairs[stack.pop(), size] += 1
        rows = [(False, i, d, i, 0, 0, 0, None, None) for i, d in enumerate(docs)] + [(True, 100 + i, g, *[None] * 6) for i, g in enumerate(gaps)]
        state = spark.createDataFrame(rows, "gap boolean, item long, size int, doc_id long, piece int, start long, ids_crc32 long, sequence_id long, offset long")
        both = []
        for kind in (False, True):
            cells = Counter((r[2], r[1] % 8) for r in rows if r[0] is kind)
            size, bucket = (np.array([c[i] for c in cells]) for i in (0, 1))
            both.append(packing.Histogram.of(size, bucket, np.array(list(cells.values())), 64, 8))
        out = packing.swept(packing.ranks(state, *both, 8), 64).collect()
        room = {100 + i: g for i, g in enumerate(gaps)}
        mine = Counter((docs[r.item], room[r.sequence_id]) for r in out if r.sequence_id is not None)
        assert mine == pairs
        left = {r.item: r.size for r in out if r.gap}
        assert sum(room.values()) - sum(left.values()) == sum(d * n for (d, _), n in pairs.items())


def test_opened_sequences_are_counted_by_bucket():
    for first, count in ((0, 1), (3, 20), (17, 0), (8, 8)):
        own = packing.Histogram(np.zeros((65, 8), np.int64)).opened(first, count)
        plain = Counter((-1 - k) % 8 for k in range(first, first + count))
        assert own.cells[64].tolist() == [plain[b] for b in range(8)] and own.total == count


def test_query(spark, folder, rows, no_docs, library):
    out = packing.op5_best_fit(spark, folder).collect()
    check(out)
    mine = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    plain = Counter()
    for number, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            plain[number, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert mine == plain
    assert len({r.sequence_id for r in out}) <= 1 + -(-sum(r.length for r in out) // 1024)
    assert packing.pack(no_docs).count() == 0


def test_long_runs_have_the_library_s_ids(spark, library):
    long = [" " * 1_200_000, "\n" * 1_100_000 + "x", "a " * 300_000, ("word\t\t" + " " * 60_000) * 9]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")
    out = defaultdict(list)
    for r in packing.pieces(docs).collect():
        out[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for number, text in enumerate(long):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert sorted(out[number]) == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n, _ in sorted(out[number])]
        assert sum(n for _, n, _ in out[number]) == len(ids)


def test_one_length_for_all(spark):
    same = spark.range(500).selectExpr("id as doc_id", "'three words here' as text")
    out = packing.pack(same).collect()
    check(out)
    assert len(out) == 500 and len({r.sequence_id for r in out}) == -(-500 // (1024 // out[0].length))
