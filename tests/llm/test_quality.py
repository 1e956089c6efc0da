import random
from collections import Counter

import numpy as np

from lexloom.llm import quality


def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(inside)


def test_repeated_words_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(2000):
        words = [rnd.choice([b"a", b"b", b"c", b"d", b"e"][: rnd.randrange(1, 6)]) for _ in range(rnd.randrange(50))]
        assert quality.repeated_words(words) == plain_repeats(words)
    many = [b"%d" % (i % 9000) for i in range(20_000)]
    assert quality.repeated_words(many) == plain_repeats(many)


def test_statistics_of_odd_texts():
    get = lambda t: dict(zip(quality.STATS, quality.statistics(t.encode()), strict=True))
    own = get("é☃ a#\xa0b\n\n \nx y\nx y\n x y\nx y")
    assert own["n_words"] == 10 and own["word_chars"] == 2 + 4 + 8 and own["n_symbols"] == 1 and own["n_dup_lines"] == 2
    assert set(get("").values()) == {0} and get(" \n\t")["n_words"] == 0


def test_list_learns_planted_rules():
    rng = np.random.default_rng(1)
    values = rng.random((3000, len(quality.FEATURES)))
    bad = (values[:, 2] > 0.8) | ((values[:, 5] > 0.7) & (values[:, 4] < 0.3))
    rules = quality.learn(values, bad)
    said = np.zeros(len(bad), bool)
    for rule in rules:
        said |= rule.holds(values)
    assert (said == bad).mean() > 0.97 and len(rules) <= 6
    assert quality.learn(values, np.zeros(3000, bool)) == [] and quality.learn(values[:0], bad[:0]) == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in quality.op4_decision_list(spark, sf).collect()}
    rules = quality.fitted(docs.filter("doc_id % 2 = 0"), labels)
    own = quality.judged(docs.filter("doc_id % 2 = 1"), rules).select("doc_id", quality.RESERVED).join(labels, "doc_id").collect()
    right = [r[quality.RESERVED].kept == bool(r.quality) for r in own if not r[quality.RESERVED].base_failed]
    assert np.mean(right) > 0.95
    assert all(not r.kept for r in out.values() if r.base_failed)


def test_query_and_edges(spark, folder, docs, rows, no_docs):
    out = quality.op4_decision_list(spark, folder).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept and by[12].base_failed and by[12].n_dup_lines == 39
    judged = quality.judged(docs, [])
    assert judged.drop(quality.RESERVED).columns == docs.columns
    assert quality.judged(no_docs, []).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.fitted(docs, none) == []


def test_a_repeated_labelled_id_teaches_once(spark):
    docs = spark.range(40_000).selectExpr("id % 4 as doc_id", "concat('word ', cast(id % 8 as string)) as text")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)] * 3 + [(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    values, bad = quality.labelled(docs, labels)
    assert values.shape == (4, len(quality.FEATURES)) and bad.tolist() == [True, True, True, False]


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b " * 4, "x", "y")], f"doc_id int, text string, {quality.RESERVED} string, kept string")
    judged = quality.judged(docs, [])
    assert judged.columns[:4] == docs.columns and judged.first()[4].n_words == 8
    docs = docs.selectExpr("doc_id", "'a b c d e f g h i j k l' as text", quality.RESERVED, "kept")
    assert quality.accepted(docs, []).columns == docs.columns and quality.accepted(docs, []).first()[quality.RESERVED] == "x"
