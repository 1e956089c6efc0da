import os
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from lexloom.llm import common, minhash
from lexloom.llm.numbering import sieved

from .conftest import body

SCHEMA = "doc_id bigint, text string, key string, bands int, bucket string, a int"


def set_of(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset(words)


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    posting = defaultdict(list)
    for i, own in enumerate(sets):
        for j in {j for s in own for j in posting[s]}:
            both = len(own & sets[j])
            if 100 * both >= 80 * len(own | sets[j]) and find(i) != find(j):
                root[find(i)] = find(j)
        for s in own:
            posting[s].append(i)
    least = defaultdict(list)
    for i, (n, _) in enumerate(rows):
        least[find(i)].append(n)
    out = []
    for i, (n, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        component = min(ids) if ids else None
        out.append((n, len(sets[i]), component, n == component))
    return sorted(out, key=str)


def query(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "k", 1, "b", 2) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in minhash.op12_minhash(spark, str(tmp_path)).collect()), key=str)


def test_query(spark, folder, rows):
    out = sorted((tuple(r) for r in minhash.op12_minhash(spark, folder).collect()), key=str)
    assert out == brute([r[:2] for r in rows])


def changed(rnd, words, many):
    words = list(words)
    for _ in range(many):
        words[rnd.randrange(len(words))] = rnd.choice("pqrstuvw") * 3 + str(rnd.randrange(1000))
    return words


@pytest.mark.parametrize("rare", [minhash.RARE, 3])
def test_links_about_the_threshold(spark, tmp_path, monkeypatch, rare):
    """Families whose members lie at similarities of 0.6 to 0.95 of each other, chains of them, texts of few words, copies, and large groups; with most shingles rare, or frequent."""
    monkeypatch.setattr(minhash, "RARE", rare)
    rnd = random.Random(3)
    rows = [(None, None), (None, "only"), (0, "  "), (1, ""), (2, "Word"), (3, "word"), (4, "two words"), (5, "Two  words")]
    for family in range(60):
        words = body(family, rnd.choice([3, 5, 8, 20, 60, 300])).split()
        for _ in range(rnd.randrange(2, 9)):
            words = changed(rnd, words, max(1, len(words) * rnd.choice([2, 4, 6, 8]) // 100))
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    base = body(999, 200).split()
    for _ in range(150):
        rows.append((len(rows) * 7 % 1009 + 2000, " ".join(changed(rnd, base, rnd.randrange(1, 12)))))
    rows += [(n + 5000, t) for n, t in rows[100:120]] + rows[200:203]
    rnd.shuffle(rows)
    assert query(spark, tmp_path, rows) == brute(rows)


def test_pairs_grow_with_the_nodes(spark):
    """A group of near copies asks for one pair a node at first, not for all pairs; later rounds only for pairs across components."""
    rnd = random.Random(4)
    base = body(1, 300).split()
    docs = spark.createDataFrame([(i, " ".join(changed(rnd, base, 2))) for i in range(400)], "doc_id bigint, text string")
    folder = common.shared_dir(spark)
    out = minhash.grouped(docs, folder)
    assert out.select("component_id").distinct().count() == 1
    checked = [n for n in os.listdir(folder.removeprefix("file://")) if "_chosen_" in n]
    assert sum(spark.read.parquet(f"{folder}/{n}").count() for n in checked) <= 800


def test_a_bucket_of_several_components_is_searched_to_the_end(spark):
    """All sets in the same buckets, whatever they hold: still every link is found."""
    rnd = random.Random(6)
    rows = []
    for family in range(12):
        words = body(family, 40).split()
        for _ in range(4):
            words = changed(rnd, words, 2)
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sketch = spark.createDataFrame([(n, len(minhash.shingles(t.encode())), hash(t) >> 2, [1, 2]) for n, t in rows], "doc_id bigint, n bigint, key bigint, bands array<bigint>")
    folder = common.shared_dir(spark)
    nodes = common.keep(sketch.select("key", "n", "bands"), folder, "nodes")
    texts = sketch.join(docs, "doc_id").select("key", "text")
    roots = {r.node: r.root for r in minhash.links(nodes, lambda keys: texts.join(keys, "key", "left_semi"), folder).collect()}
    keys = {r.doc_id: r.key for r in sketch.collect()}
    groups = defaultdict(set)
    for n, k in keys.items():
        groups[roots.get(k, k)].add(n)
    known = defaultdict(set)
    for n, _, component, _ in brute(rows):
        known[component].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, known.values()))


def test_what_the_centres_have_settled_is_not_searched_again(spark):
    """Pairs of near misses, each in buckets that nobody else is in: their centre has met the other, so no node is open."""
    rnd = random.Random(7)
    rows = []
    for pair in range(30):
        words = body(700 + pair, 100).split()
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(changed(rnd, words, 7)))]
    folder = common.shared_dir(spark)
    out = minhash.grouped(spark.createDataFrame(rows, "doc_id bigint, text string"), folder)
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == sorted((n, c) for n, _, c, _ in brute(rows))
    assert spark.read.parquet(f"{folder}/pairs").count() > 20 and spark.read.parquet(f"{folder}/open").count() == 0


def test_a_round_takes_up_its_centres_only(spark, monkeypatch):
    """Sets with frequent shingles in common that are not similar: each round reads on in their buckets, but asks only its centres whether their bucket is still mixed."""
    monkeypatch.setattr(minhash, "RARE", 3)
    monkeypatch.setattr(minhash, "MORE", 2)
    real, made = minhash.mixed_buckets, []

    def mixed(*given):
        out = real(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "mixed_buckets", mixed)
    rnd = random.Random(8)
    rows = [(n, " ".join(rnd.choice("abcdef") for _ in range(14))) for n in range(60)]
    sketch = spark.createDataFrame([(len(minhash.shingles(t.encode())), n, [1, 2]) for n, t in rows], "n bigint, key bigint, bands array<bigint>")
    texts = spark.createDataFrame(rows, "key bigint, text string")
    folder = common.shared_dir(spark)
    nodes = common.keep(sketch, folder, "nodes")
    minhash.links(nodes, lambda keys: texts.join(keys, "key", "left_semi"), folder)
    rounds = made[1:]
    frequent = spark.read.parquet(f"{folder}/prefixes").filter("often > 3").count()
    assert len(rounds) > 3 and rounds[-1] == 0 and 0 < sum(rounds) <= frequent


def test_buckets_are_not_kept_beyond_their_use(spark):
    """What is left in the shared folder when the groups are known holds no bands, neither of rows nor of nodes."""
    folder = common.shared_dir(spark)
    docs = spark.createDataFrame([(n, body(900 + n // 3, 40) + f" end{n % 3}") for n in range(60)], "doc_id bigint, text string")
    assert minhash.grouped(docs, folder).count() == 60
    kept = {p.parent.name for p in Path(folder.removeprefix("file://")).glob("*/*.parquet")}
    assert {"rows", "nodes"} <= kept
    assert not [n for n in kept if "bands" in spark.read.parquet(f"{folder}/{n}").columns]


def test_only_texts_that_may_have_a_link_are_moved(spark):
    docs = spark.range(20_000).selectExpr("CAST(id AS STRING) AS id", "xxhash64(id) AS hash", "'t' AS text")
    wanted = docs.filter("CAST(id AS INT) % 20 = 0").select("id", "hash")
    out = {r.id for r in sieved(docs, wanted, ["id", "hash"]).select("id").collect()}
    assert out >= {str(i) for i in range(0, 20_000, 20)} and len(out) < 3000
    assert sieved(docs, wanted.limit(0), ["id", "hash"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 79, 2000])
def test_sketch_values_agree_as_often_as_sets_do(n):
    rnd = np.random.default_rng(n)
    hits = total = 0
    for _ in range(40):
        shared = rnd.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.unique(np.append(shared, rnd.integers(0, 2**63, n // 8, dtype=np.uint64))) for _ in range(2))
        for p in range(minhash.PERMUTATIONS):
            hits += int((minhash.sketch(a, p) == minhash.sketch(b, p)).sum())
            total += minhash.BINS
    expected = n / (n + 2 * (n // 8))
    assert abs(hits / total - expected) < 0.04


def test_a_long_text_and_an_empty_table(spark, tmp_path):
    long = body(5, 200_000)
    assert query(spark, tmp_path, [(3, long), (1, long + " end"), (2, "short text")]) == brute([(3, long), (1, long + " end"), (2, "short text")])
    assert minhash.grouped(spark.createDataFrame([], SCHEMA), common.shared_dir(spark)).count() == 0
