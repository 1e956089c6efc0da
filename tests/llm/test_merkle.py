import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import common, merkle
from lexloom.llm.numbering import numbered


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def steps(nodes):
    """The root of a list of nodes, and each node's steps."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(at, min(at + 8, len(nodes))) for at in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                for own in under[i]:
                    paths[own].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        under = [[own for i in run for own in under[i]] for run in runs]
        nodes = [h("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for n, text, lang, source, chars in rows:
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        changed = n is not None and zlib.crc32(str(n).encode()) % 3 == 0
        groups[lang].append((n is not None, n or 0, leaf_of(n, source, lang, chars, text), leaf_of(n, source, lang, chars, low if changed else text), n))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: steps([r[2] for r in sorted(groups[g])]) for g in names}
    root, over = steps([trees[g][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for row, path in zip(sorted(groups[g]), trees[g][1], strict=True):
            path, node = path + over[place], row[3]
            for left, right in path:
                node = h(left + node + right)
            out.append((row[4], row[2], trees[g][0], root, h("".join(a + b for a, b in path)), node, node == root))
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, path int, leaf string, n int"


def query(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "t", 1, "l", 2) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path)).collect()]


def test_query(spark, folder, rows):
    out = [tuple(r) for r in merkle.op11_merkle(spark, folder).collect()]
    assert sorted(map(str, out)) == sorted(map(str, brute([r[:5] for r in rows])))


def test_groups_of_many_sizes_nulls_and_repeats(spark, tmp_path):
    """Groups of 1 to 1100 rows (over two blocks), odd names, null and repeated rows, a third with one id."""
    langs = {None: 3, "": 1, "é": 9, "z": 64, "Z": 8, "en": 1100, "+": 65, "a b": 2}
    rows = [(None if i % 50 == 7 else 5 if i % 3 == 0 else i, None if i % 11 == 0 else "" if i % 13 == 0 else f"Text Nr {i % 40} ÄÖ", lang, None if i % 7 == 0 else "s", i % 5 or None) for lang, n in langs.items() for i in range(n)]
    out = query(spark, tmp_path, rows)
    assert sorted(map(str, out)) == sorted(map(str, brute(rows)))
    assert 0 < sum(not r[-1] for r in out) < len(out)


def test_many_groups(spark, tmp_path):
    rows = [(i, "A" * (i % 3), f"g{i % 700}", "s", 1) for i in range(1400)]
    assert sorted(map(str, query(spark, tmp_path, rows))) == sorted(map(str, brute(rows)))


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 72, 100, 449, 511, 512])
def test_traversal_gives_the_paths_of_the_whole_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    root, paths = steps(leaves)
    height = merkle.levels(n)
    assert [list(p) for p in merkle.traversed(leaves, height)] == paths
    assert merkle.grown(leaves, height) == [root]


def test_traversal_holds_a_few_runs_for_each_height(monkeypatch):
    """The open runs and nodes that desired subtrees hold never exceed two runs for each height."""
    most = 0
    push = merkle.Growing.push

    def seen(self, *args):
        nonlocal most
        push(self, *args)
        most = max(most, len(self.nodes) + sum(map(len, self.runs)))

    monkeypatch.setattr(merkle.Growing, "push", seen)
    for _ in merkle.traversed([h(str(i)) for i in range(4096)], 4):
        pass
    assert most <= 8 * 4


def test_a_long_text_and_a_changed_one(spark, tmp_path):
    rows = [(1, "Ab" * 2_000_000, "en", "s", 4), (2, "x", "en", "s", 1)]
    assert sorted(map(str, query(spark, tmp_path, rows))) == sorted(map(str, brute(rows)))


def test_numbering_with_a_frequent_key(spark):
    folder = common.shared_dir(spark)
    rows = common.keep(spark.range(5000).selectExpr("if(id % 3 = 0, 7, id % 900) as k", "cast(id % 2 as string) as g", "id").repartition(5), folder, "rows")
    out = numbered(rows, ["g"], [F.col("k")], folder, "t").collect()
    for g in "01":
        own = sorted((r for r in out if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [r.k for r in own] == sorted(r.k for r in own)
    assert numbered(rows.limit(0), [], [F.col("k")], folder, "none").count() == 0
