"""The inverted index and the vector clusters give what scoring everything gives, and read less."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import bm25, clusters, postings


def corpus(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, rnd.choice("ab"), " ".join(rnd.choices(words, [1 / (1 + j) for j in range(400)], k=rnd.randrange(0, 60)))) for i in range(3000)]
    rows += [(5000 + i, "a", f"needle{i % 7} w1 w2 haystack") for i in range(30)] + [(6000, "b", None), (6001, "b", "")]
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(5)


def asked(spark):
    rows = [(1, "needle3 w300 w301"), (2, "w0 w1 w399"), (3, "unknown words"), (4, "needle1 needle1 needle2"), (5, "w0")]
    return bm25.query_terms(spark.createDataFrame(rows, "id bigint, q string"), "id", "q")


@pytest.mark.parametrize("per_scope", [False, True])
def test_pruned_search_equals_scoring_all(spark, monkeypatch, per_scope):
    monkeypatch.setattr(postings, "SEGMENT", 16)
    monkeypatch.setattr(postings, "SPAN", 8)
    docs, terms = corpus(spark), asked(spark)
    index = postings.build(docs, "doc_id", "text", "lang")
    found = postings.search(index, terms, 5, per_scope=per_scope)
    scope = ("lang",) if per_scope else ()
    known = bm25.ranked(bm25.scores(bm25.tokenised(docs, "doc_id", "text", "lang"), terms, *scope), 5, ["query_id", *scope], "doc_id")
    own = {(r.query_id, r.scope if per_scope else "", r["rank"]): (r.doc_id, round(r.score, 9)) for r in found.hits.collect()}
    assert own == {(r.query_id, r.lang if per_scope else "", r["rank"]): (r.doc_id, round(r.score, 9)) for r in known.collect()}
    report = {r.query_id: r for r in found.report.groupBy("query_id").agg(F.sum("segments").alias("segments"), F.sum("segments_read").alias("read")).collect()}
    assert report[1].read < report[1].segments / 3 and all(r.read <= r.segments for r in report.values()) and 3 not in report
    index.drop()


def test_index_statistics_and_an_empty_corpus(spark):
    docs = corpus(spark)
    index = postings.build(docs, "doc_id", "text", "lang")
    stats = bm25.length_stats(bm25.tokenised(docs, "doc_id", "text", "lang"), "lang")
    assert {(r.scope, r.n_docs, r.n_tokens) for r in index.scopes.collect()} == {(r.lang, r.n_docs, r.n_tokens) for r in stats.collect()}
    none = postings.build(docs.limit(0), "doc_id", "text", "lang")
    assert postings.search(none, asked(spark), 3).hits.count() == 0


def test_a_larger_corpus_has_more_tasks_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(postings, "PART_CHARS", 5000)
    monkeypatch.setattr(postings, "PART_PAIRS", 1000)
    docs, terms = corpus(spark), asked(spark)
    index = postings.build(docs, "doc_id", "text", "lang")
    files = {t: index.table(t).select(F.input_file_name().alias("f")).distinct().count() for t in ("blocks", "spans", "frequencies")}
    assert all(n > 12 for n in files.values()), files  # the session has four shuffle partitions
    assert postings.pair_parts(index, terms) == -(-5 * docs.count() // 1000)
    found = postings.search(index, terms, 5, digits=6)
    known = bm25.scores(bm25.tokenised(docs, "doc_id", "text"), terms).withColumn("score", F.round("score", 6))
    rows = lambda own: sorted((r.query_id, r["rank"], r.doc_id) for r in own.collect())
    assert rows(found.hits) == rows(bm25.ranked(known, 5, ["query_id"], "doc_id"))


def vectors(spark, seed=1, many=3000, wide=12):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(20, wide))
    rows = [(i, (middle[i % 20] + 0.15 * rnd.normal(size=wide)).tolist()) for i in range(many)]
    rows += [(10_000 + i, rows[5][1]) for i in range(200)] + [(20_000, None), (20_001, [0.0] * wide), (20_002, rows[7][1][:6])]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)


def test_nearest_vectors_equal_brute_force(spark):
    rows, frame = vectors(spark)
    index = clusters.build(frame, "vec_id", "embedding")
    questions = [(1, rows[5][1]), (2, rows[77][1]), (3, None), (4, [0.1] * 12), (5, [-x for x in rows[3][1]]), (6, rows[8][1][:4])]
    found = clusters.search(index, spark.createDataFrame(questions, "query_id bigint, query_vector array<double>"), 7)
    full = np.array([np.pad(v or [0.0], (0, 12 - len(v or [0.0]))) for _, v in rows])
    size = np.linalg.norm(full, axis=1)
    own = {}
    for r in found.hits.collect():
        own.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.score, 9))
    for number, q in questions:
        q = np.pad(q or [0.0], (0, 12 - len(q or [0.0])))
        score = np.divide(full @ q, size * np.linalg.norm(q), out=np.zeros(len(full)), where=size * np.linalg.norm(q) > 0)
        scores = [round(s, 9) for s in sorted(score, reverse=True)[:7]]
        assert [own[number][i][1] for i in range(1, 8)] == pytest.approx(scores, abs=1e-8)
    assert [own[1][i][0] for i in range(1, 8)] == [5, *range(10_000, 10_006)]
    report = {r.query_id: r for r in found.report.collect()}
    assert report[2].vectors_read < report[2].vectors / 3 and report[2].vectors == len(rows)


def test_no_vectors_and_no_questions(spark):
    rows, frame = vectors(spark, many=40)
    index = clusters.build(frame, "vec_id", "embedding")
    assert clusters.search(index, spark.createDataFrame([], "query_id bigint, query_vector array<double>"), 3).hits.count() == 0
    none = clusters.build(frame.limit(0), "vec_id", "embedding")
    assert clusters.search(none, spark.createDataFrame([(1, rows[0][1])], "query_id bigint, query_vector array<double>"), 3).hits.count() == 0


def test_scoring_reads_texts_once_and_sums_where_postings_are(spark):
    """No tokens are left in the scores' plan, and pairs of question and document are not shuffled."""
    docs, terms = corpus(spark), spark.createDataFrame(asked(spark).collect(), "query_id bigint, term string, times bigint")
    for scope in ([], ["lang"]):
        plan = bm25.scores(bm25.tokenised(docs, "doc_id", "text", *scope), terms, *scope)._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan and "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)
