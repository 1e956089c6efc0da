import random
from collections import defaultdict

import numpy as np
import xxhash

from lexloom.llm import dedup, simhash
from lexloom.llm.graph import components


def plain_fingerprint(text: str) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes: list[int]) -> dict[int, int]:
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if bin(a ^ b).count("1") <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


def signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def clusters(seed: int, centres: int, members: int, flips: int) -> list[int]:
    rnd = random.Random(seed)
    out = set()
    for _ in range(centres):
        code = rnd.getrandbits(64)
        for _ in range(members):
            out.add(code)
            for _ in range(rnd.randrange(flips + 1)):
                code ^= 1 << rnd.randrange(64)
    return sorted(out)


def test_fingerprint_is_as_defined():
    rnd = random.Random(1)
    for _ in range(200):
        text = " ".join(rnd.choice(["Ab", "é", "C", "d,", "\t", "\n", "\xa0", "Ä"]) for _ in range(rnd.randrange(30)))
        assert simhash.fingerprint(text.encode()) == signed(plain_fingerprint(text))


def test_manhattan_bounds_hamming_and_projections_are_complete():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64)
    shape_a, shape_b = simhash.thermometers(a), simhash.thermometers(b)
    assert (np.bitwise_count(shape_a ^ shape_b) <= np.bitwise_count(a ^ b)).all()
    pairs = [(x >> 2 * s) & 3 for x in a[:50].tolist() for s in range(32)]
    counts = [(x >> 2 * s) & 3 for x in shape_a[:50].tolist() for s in range(32)]
    assert counts == [(0, 1, 1, 3)[p] for p in pairs]
    for blocks in range(simhash.LEAST_BLOCKS, 11):
        masks = np.array(simhash.projections(blocks), np.int64).view(np.uint64)
        met = ((shape_a[:, None] ^ shape_b[:, None]) & masks[None, :]) == 0
        assert met.any(axis=1).all()


def test_blocks_grow_with_the_rows():
    sizes = [simhash.blocks_for(10**n) for n in range(1, 13)]
    assert sizes[0] == simhash.LEAST_BLOCKS and sizes == sorted(sizes) and sizes[-1] <= simhash.MOST_BLOCKS and sizes[-1] > 10


def test_long_texts_are_hashed_in_runs(monkeypatch):
    text = " ".join(random.Random(4).choice("abcdefgh") * 3 for _ in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "HASHES_HELD", 7)
    assert simhash.fingerprint(text.encode()) == whole == signed(plain_fingerprint(text))


def held(spark, codes: list[int]) -> None:
    frame = spark.createDataFrame([(signed(c),) for c in codes], "code bigint")
    folder = simhash.shared_dir(spark)
    roots = {r.node: r.root for r in components(simhash.links(frame, folder), folder).collect()}
    mine = defaultdict(set)
    for c in codes:
        mine[roots.get(signed(c), signed(c))].add(c)
    plain = defaultdict(set)
    for c, root in plain_groups(codes).items():
        plain[root].add(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


def test_components_equal_brute_force(spark):
    held(spark, clusters(7, 40, 12, 5))


def test_large_cells_are_handed_on_whole(spark, monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setattr(simhash, "CHUNK", 8)
    cloudpickle.register_pickle_by_value(simhash)  # so that workers see the small chunk
    try:
        held(spark, clusters(8, 3, 120, 3))
    finally:
        cloudpickle.unregister_pickle_by_value(simhash)


def test_chunks_of_one_cell():
    import pyarrow as pa

    codes = np.array(clusters(9, 1, 100, 2), np.uint64)
    cell = np.zeros(len(codes), np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(cell[i : i + 7]), pa.array(codes[i : i + 7].view(np.int64))], names=["cell", "code"]) for i in range(0, len(codes), 7)]
    whole = pa.Table.from_batches(list(simhash.linked(iter(batches)))).to_pylist()
    assert all(r["kind"] == simhash.EDGE for r in whole) and len(whole) <= len(codes) - 1


def test_query_and_removal(spark, folder, docs, rows, no_docs):
    out = simhash.op7_simhash(spark, folder).collect()
    assert len(out) == len(rows)
    codes = {f"{plain_fingerprint(t or ''):016x}" for _, t, *_ in rows}
    assert {r.fingerprint for r in out} == codes
    groups = plain_groups(sorted(int(c, 16) for c in codes))
    least: dict[int, int] = {}
    for r in out:
        if r.doc_id is not None:
            root = groups[int(r.fingerprint, 16)]
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    for r in out:
        assert r.component_id == least.get(groups[int(r.fingerprint, 16)])
    kept = dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(groups.values()))
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 6 not in ids and 1 in ids and 2 not in ids
    assert dedup.deduplicated(no_docs).count() == 0


def test_components_of_odd_graphs(spark):
    def roots(edges):
        return {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), simhash.shared_dir(spark)).collect()}

    assert roots([(1, 1)]) == {}
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 160)]
    out = roots(chain + star + [(5, 5), (3, 2)])
    assert all(out[i] == 0 for i in range(61)) and all(out[i] == 100 for i in range(100, 160))


def test_a_centre_of_very_many_edges_is_dealt(spark):
    from lexloom.llm import graph

    edges = spark.range(1, 20_000).selectExpr("0L as u", "id as v")
    rows = graph.with_least(edges)
    assert {r.m for r in rows.select("m").distinct().collect()} == {1} and rows.count() == 19_999
    out = components(spark.range(1, 20_000).selectExpr("id as a", "0L as b"), simhash.shared_dir(spark))
    assert out.count() == 20_000 and out.filter("root <> 0").count() == 0
    assert components(spark.createDataFrame([], "a bigint, b bigint"), simhash.shared_dir(spark)).count() == 0


def test_removal_keeps_columns_of_any_name(spark):
    names = ["__lexloom_own_hash", "__lexloom_text_hash", "__lexloom_kept_id", "hash", "code", "n"]
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([text, text, None, "", "other words stand in here alone"])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id int", "text string", *(f"{n} string" for n in names)]))
    kept = dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]
    assert {tuple(r) for r in kept.collect()} <= set(rows)
