"""Answers for batches of questions: refuse, quote or synthesise, compare, validate, highlight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models, planner, text
from ..functions.structure import citation, defined_term, is_redirect
from ..settings import DEFAULT, Settings
from . import context, hybrid
from .lineage import settled

RESULT = ("query_id", "question", "question_type", "mode", "answer_path", "answer", "confidence", "warnings", "sources", "fragments", "replaced")
EMPTY, TOO_LONG = "the question is empty", "the question is too long"
NO_PASSAGE, BOTH_NEEDED = "no passage found", "upload both regulations to compare them"


def cited(hits: DataFrame) -> DataFrame:
    return hits.withColumn("citation", citation(F.col("short_label"), F.col("filename"), F.col("article_num"), F.col("paragraph"), F.col("section_path"), F.col("page")))


def picked_definition(hits: DataFrame) -> DataFrame:
    """(query_id, direct): the first substantive definition of the subject; the first substantive one if the plan has no subject; else none."""
    own = hits.filter((F.col("chunk_kind") == "definition") & ~is_redirect(F.col("content")))
    fits = F.col("subject_term").isNull() | F.coalesce(defined_term(F.col("content")) == F.col("subject_term"), F.lit(False))
    return own.filter(fits).groupBy("query_id").agg(F.min_by(quoted(), "rank").alias("direct"))


def quoted() -> Column:
    return F.concat("content", F.lit("\n\n["), "citation", F.lit("]"))


def direct_answers(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, direct) where the plan allows a quote and confidence suffices: a definition, or a first hit that is a list."""
    allowed = hits.filter(F.col("allows_direct_answer") & (F.col("confidence") >= settings.direct_answer))
    lists = allowed.filter((F.col("question_type") == "list") & (F.col("rank") == 1) & (F.col("chunk_kind") == "list")).select("query_id", quoted().alias("direct"))
    return picked_definition(allowed.filter(F.col("question_type") == "definition")).unionByName(lists)


def source_list(hits: DataFrame) -> DataFrame:
    """(query_id, sources, labels): hits by rank with scores to four places, and the labels an answer may cite."""
    item = F.struct(
        "rank", "citation", F.bround("score", 4).alias("score"), F.bround("semantic_score", 4).alias("semantic_score"), F.bround("keyword_score", 4).alias("keyword_score"),
        F.bround("structure_score", 4).alias("structure_score"), "chunk_id", "short_label", "filename", "content",
    )
    label = F.coalesce(F.nullif("short_label", F.lit("")), F.col("filename"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("sources"), F.array_union(F.collect_set("citation"), F.collect_set(label)).alias("labels"))


def answer(questions: DataFrame, chunks: DataFrame, embedder: models.Embedder | None = None, chat: models.ChatModel | None = None, settings: Settings = DEFAULT, all_chunks: DataFrame | None = None) -> DataFrame:
    """One row for each question (``query_id``, ``question``). Comparisons see ``all_chunks``, if given, whatever ``chunks`` is narrowed to.

    ``chunks``: ready chunks joined with their documents (chunk_id, document_id, chunk_index, content, embedding, page, article, article_num, paragraph,
    section_path, chunk_kind, doc_kind, short_label, filename). Only questions that nothing answers directly reach the chat model. Empty and too long
    questions are rejected, with the reason as their warning. ``fragments`` are what the model said, in its pieces; ``replaced`` tells that the answer is another.
    """
    embedder = embedder or models.HashEmbedder(settings.embed_width)
    chat = chat or models.ScriptedChat(text.NO_ANSWER)
    plans = planner.planned(questions)
    fits = F.coalesce(F.length("question").between(1, settings.max_question_chars), F.lit(False))
    refused = plans.filter(~fits)
    plans = plans.filter(fits).withColumn("query_vector", embedder.as_column(F.col("question")))
    asked = plans.filter(~F.col("is_comparison"))
    compared = plans.filter("is_comparison")
    out = asks(asked, chunks, chat, settings).unionByName(comparisons(compared, chunks if all_chunks is None else all_chunks, chat, settings))
    return out.unionByName(rejected(refused, out))


def rejected(plans: DataFrame, like: DataFrame) -> DataFrame:
    """Rows in the form of ``like`` for questions that are not asked."""
    reason = F.when(F.coalesce(F.length("question"), F.lit(0)) == 0, EMPTY).otherwise(TOO_LONG)
    given = {
        "query_id": F.col("query_id"), "question": F.col("question"), "question_type": F.col("question_type"), "mode": F.lit("ask"), "answer_path": F.lit("rejected"), "answer": F.lit(""),
        "confidence": F.lit(0.0), "warnings": F.array(reason), "sources": F.array(), "fragments": F.array(), "replaced": F.lit(False),
    }
    return plans.select(*(given[f.name].cast(f.dataType).alias(f.name) for f in like.schema))


def finished(rows: DataFrame, settings: Settings) -> DataFrame:
    """Validate raw answers, name the path, mark supporting spans."""
    checked = rows.withColumn("__v", text.validated(F.coalesce("raw", F.lit("")), F.coalesce("labels", F.array().cast("array<string>")), F.col("confidence"), settings.min_answerable))
    spans = F.transform(F.coalesce("sources", F.array().cast(rows.schema["sources"].dataType)), lambda s: s.withField("highlights", text.supporting_spans(s["content"], F.col("answer"), settings.min_overlap, settings.max_spans)))
    path = F.when(F.col("given_path").isNotNull(), F.col("given_path")).when(text.is_refusal(F.col("answer")), "refused").otherwise("synthesis")
    given = F.col("given_path").isNotNull()
    own = checked.withColumn("answer", F.when(given, F.col("raw")).otherwise(F.col("__v.answer")))
    own = own.withColumn("warnings", F.when(given, F.coalesce("given_warnings", F.array().cast("array<string>"))).otherwise(F.col("__v.warnings")))
    own = own.withColumn("replaced", ~given & (F.col("answer") != F.coalesce(text.strip(F.col("raw")), F.lit(""))))
    own = own.withColumn("fragments", F.when(given, F.array("raw")).otherwise(F.coalesce("fragments", F.array().cast("array<string>"))))
    return own.withColumn("answer_path", path).withColumn("sources", spans).select(*RESULT)


def asks(plans: DataFrame, chunks: DataFrame, chat: models.ChatModel, settings: Settings = DEFAULT) -> DataFrame:
    hits = cited(hybrid.retrieve(plans, chunks, settings))
    planned = plans.select("query_id", "preferred_chunk_kinds", "allows_direct_answer", "question_type", "subject_term")
    hits = settled(hits.join(planned, "query_id"))
    sure = hybrid.confidence(hits)
    hits = settled(hits.join(sure, "query_id"))  # a few rows for each question, read by every step below
    direct = direct_answers(hits, settings)
    entries = context.expanded(hits, chunks, settings.max_context_chars, settings.expand_top_n)
    own = plans.join(sure, "query_id", "left").join(direct, "query_id", "left").join(source_list(hits), "query_id", "left").join(context.rendered(entries, "query_id"), "query_id", "left")
    own = own.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    refused = F.col("confidence") < settings.min_answerable
    user = F.when(~refused & F.col("direct").isNull(), F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "question"))
    own = own.withColumn("fragments", chat.as_fragments(models.prompt_for(F.col("question_type")), user))
    own = own.withColumn("given_path", F.when(refused, "refused").when(F.col("direct").isNotNull(), "direct"))
    own = own.withColumn("given_warnings", F.when(refused, F.array(F.lit(NO_PASSAGE))))
    own = own.withColumn("raw", F.when(refused, F.lit(text.NO_ANSWER)).otherwise(F.coalesce("direct", models.said(F.col("fragments"))))).withColumn("mode", F.lit("ask"))
    return finished(own, settings)


def coverage(plans: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, kinds, covered, missing): the kinds a comparison wants, those with hits, and those without."""
    wanted = plans.select("query_id", F.when(F.size("doc_kinds") > 0, F.col("doc_kinds")).otherwise(planner.strings(("mdr", "ivdr"))).alias("kinds"))
    got = hits.groupBy("query_id").agg(F.collect_set("doc_kind").alias("got"))
    own = wanted.join(got, "query_id", "left").withColumn("got", F.coalesce("got", planner.strings(())))
    return own.select("query_id", "kinds", F.array_intersect("kinds", "got").alias("covered"), F.array_except("kinds", "got").alias("missing"))


def comparisons(plans: DataFrame, chunks: DataFrame, chat: models.ChatModel, settings: Settings = DEFAULT) -> DataFrame:
    """Comparisons need hits of two kinds; they know no least confidence, and no document filter."""
    scoped = plans.withColumn("doc_kinds", F.when(F.size("doc_kinds") > 0, F.col("doc_kinds")).otherwise(planner.strings(("mdr", "ivdr"))))
    per_kind = settled(cited(hybrid.retrieve_per_kind(scoped, chunks, settings)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    pooled = per_kind.withColumn("kind_rank", F.col("rank")).withColumn("rank", F.row_number().over(order))
    sure = hybrid.confidence(pooled.join(plans.select("query_id", "preferred_chunk_kinds"), "query_id"))
    cover = coverage(plans, per_kind)
    kept = context.primary(per_kind, settings.comparison_context_chars, ("query_id", "doc_kind")).withColumn("ord", F.col("rank").cast("bigint"))
    label = per_kind.filter(F.col("rank") == 1).select("query_id", "doc_kind", F.coalesce(F.nullif("short_label", F.lit("")), F.upper("doc_kind")).alias("label"))
    bodies = context.rendered(kept, "query_id", "doc_kind").join(label, ["query_id", "doc_kind"]).join(cover.select("query_id", "kinds"), "query_id")
    part = F.struct(F.array_position("kinds", F.col("doc_kind")).alias("at"), context.section(F.col("label"), F.col("context")).alias("body"))
    whole = bodies.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["body"]), "\n\n").alias("context"))
    own = plans.join(sure, "query_id", "left").join(cover, "query_id").join(source_list(pooled), "query_id", "left").join(whole, "query_id", "left")
    own = own.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    one_sided = F.size("covered") < 2
    named = F.concat(F.lit("A comparison needs both regulations, indexed and relevant. Nothing relevant was found for: "), F.array_join(F.transform("missing", F.upper), ", "), F.lit("."))
    user = F.when(~one_sided, F.concat(F.lit("Context:\n"), "context", F.lit("\n\nComparison question: "), "question"))
    own = own.withColumn("fragments", chat.as_fragments(F.lit(models.PROMPTS["comparison"]), user))
    own = own.withColumn("given_path", F.when(one_sided, "refused")).withColumn("given_warnings", F.when(one_sided, F.array(F.lit(BOTH_NEEDED))))
    own = own.withColumn("raw", F.when(one_sided, named).otherwise(models.said(F.col("fragments"))))
    own = own.withColumn("question_type", F.lit("comparison")).withColumn("mode", F.lit("compare"))
    return finished(own, settings)


def evaluation(results: DataFrame) -> DataFrame:
    """One row on a run of questions (``passed`` boolean, ``elapsed_ms``): how many, how many passed, mean and longest seconds."""
    seconds = F.col("elapsed_ms") / 1000.0
    return results.agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.avg(seconds).alias("avg_seconds"), F.max(seconds).alias("max_seconds"))
