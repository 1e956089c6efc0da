"""Text, planner and vector functions on single values."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lexloom.functions import planner, structure, text, vector
from lexloom.settings import Settings


def one(spark, value, column, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert one(spark, "The Éclair, a 2nd B c2 the", text.tokens) == ["clair", "2nd", "c2"]


def test_sentences_keep_offsets(spark):
    source = "First one. Second (two); (3) third\n\n  last: 4 end.  "
    for s in one(spark, source, text.sentences):
        assert source[s.start : s.end] == s.sentence
    assert [s.sentence for s in one(spark, source, text.sentences)] == ["First one.", "Second (two);", "(3) third", "last:", "4 end."]


def test_supporting_spans_are_the_best_three(spark):
    content = "Alpha beta gamma delta. Alpha beta. Nothing here at all. Gamma delta alpha beta epsilon zeta."
    out = spark.createDataFrame([(content, "alpha beta gamma delta epsilon zeta")], "c string, a string").select(text.supporting_spans(F.col("c"), F.col("a")).alias("s")).first().s
    assert [content[s.start : s.end] for s in out] == ["Alpha beta gamma delta.", "Gamma delta alpha beta epsilon zeta."]
    assert out[0].score == round(4 / 6, 3)


def test_clamped_spans_never_overlap(spark):
    frame = spark.createDataFrame([([(5, 9), (0, 6), (8, 99)],)], "x array<struct<start:int,end:int>>")
    out = frame.select(text.clamped_spans(F.col("x"), F.lit(20)).alias("y")).first().y
    assert [(s.start, s.end) for s in out] == [(0, 6), (6, 9), (9, 20)]


@pytest.mark.parametrize(
    ("answer", "confidence", "warnings", "kept"),
    [
        ("Fine [MDR, Article 2].", 0.9, [], True),
        ("Odd [Nowhere at all].", 0.9, ["unsupported citation"], True),
        ("  ", 0.9, ["empty answer"], False),
        ("The same long sentence once more. " * 5, 0.9, ["repetitive answer"], False),
        ("Short. Short. Short. Short. Short.", 0.1, ["low confidence"], True),
        (text.NO_ANSWER, 0.1, [], True),
    ],
)
def test_validation(spark, answer, confidence, warnings, kept):
    labels = F.array(F.lit("MDR, Article 2(1)"), F.lit("MDR"))
    out = one(spark, answer, lambda x: text.validated(x, labels, F.lit(confidence)))
    assert out.warnings == warnings and out.answer == (answer.strip() if kept else text.NO_ANSWER)


def test_refusal_sentence_is_one(spark):
    assert one(spark, text.NO_ANSWER, text.is_refusal) and not one(spark, "It does.", text.is_refusal)


def test_cosine_over_the_shorter_length(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0], [], [0.0])], "a array<double>, b array<double>, c array<double>, d array<double>")
    row = frame.select(*(vector.cosine(F.col("a"), F.col(x)).alias(x) for x in "bcd")).first()
    assert math.isclose(row.b, 2 / (3 * 2)) and row.c == 0 and row.d == 0


def test_hash_embedding_matches_its_definition(spark):
    out = one(spark, "risk device risk", vector.hash_embedding)
    plain = [0.0] * 128
    for token in ("risk", "device", "risk"):
        digest = hashlib.md5(token.encode()).digest()
        plain[int.from_bytes(digest[:4], "big") % 128] += 1 if digest[4] % 2 == 0 else -1
    size = math.sqrt(sum(x * x for x in plain))
    assert all(math.isclose(a, b / size, abs_tol=1e-12) for a, b in zip(out, plain, strict=True))
    assert set(one(spark, "", vector.hash_embedding)) == {0.0}


@pytest.mark.parametrize(
    ("question", "kind"),
    [
        ("What is a device?", "definition"), ("Define device", "definition"), ("Who is an importer?", "definition"), ("What are the obligations of importers?", "obligation"), ("Who must register?", "obligation"),
        ("List all the annexes", "list"), ("When does it apply?", "condition"), ("How do I register?", "procedure"), ("What is the difference between A and B?", "comparison"), ("Compare A with B", "comparison"),
        ("Summarise chapter I", "summary"), ("Tell me more", "general"), ("Under what circumstances may it?", "condition"), ("Which papers are required?", "list"), ("Which are required?", "general"),
    ],
)
def test_question_types(spark, question, kind):
    assert one(spark, question, planner.question_type) == kind


def test_plan_quirks_are_kept(spark):
    plans = {r.question: r for r in planner.planned(spark.createDataFrame([("What is an importer?",), ("What are articles?",), ("the maker's and the importer's duty",), ("What is it in the MDR and the IVDR?",)], "question string")).collect()}
    assert plans["What is an importer?"].subject_term == "n importer" and plans["What are articles?"].subject_term == "rticles"
    assert plans["the maker's and the importer's duty"].quoted_terms == ["s and the importer"]
    both = plans["What is it in the MDR and the IVDR?"]
    assert both.is_comparison and both.question_type == "definition" and both.doc_kinds == ["mdr", "ivdr"]
    strict = planner.planned(spark.createDataFrame([("What is an importer?",)], "question string"), strict=True).first()
    assert strict.subject_term == "importer"


def test_document_kinds(spark):
    kind = lambda t: tuple(one(spark, t, structure.document_kind))
    assert kind("REGULATION (EU) 2017/746 OF THE EUROPEAN PARLIAMENT and 2017/745") == ("ivdr", "IVDR")
    assert kind("Regulation (EU) 2016/1 of the European Parliament") == ("regulation", "2016/1")
    assert kind("see 2017/746 then 2017/745") == ("ivdr", "IVDR") and kind("x\nArticle 4\n") == ("regulation", None)
    assert kind("Directive (EC) 98/79\nArticle 1") == ("regulation", None) and kind("a note") == ("general", None)


def test_redirects_are_short(spark):
    short = "'x' means x as defined in point 1 of Article 2 of Regulation 5"
    assert one(spark, short, structure.is_redirect) and not one(spark, short + " y" * 200, structure.is_redirect)


def test_settings_come_from_the_environment():
    own = Settings.from_env({"LEXLOOM_TOP_K": "9", "LEXLOOM_BM25_B": "0.5"})
    assert own.top_k == 9 and own.bm25_b == 0.5 and own.max_spans == 3
