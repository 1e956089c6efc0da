"""Queries on question plans, hybrid retrieval, context and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import planner, structure, text
from ..functions.models import HashEmbedder
from ..operators import answer, context, hybrid
from ..operators.lineage import settled
from . import fixtures
from .registry import ORACLES, query, quoted, table
from .structure_queries import BLOCKS, DEFINED_SQL, REDIRECT_SQL, STRIP, all_blocks
from .text_queries import COSINE, tok


def sql_pattern(pattern: str) -> str:
    return quoted("(?i)" + pattern)


TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(question, {sql_pattern(planner.any_of(p))}) THEN '{k}'" for k, p in planner.CUES.items()) + " ELSE 'general' END"
KINDS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(question, {sql_pattern(p)}) THEN '{k}' END" for k, p in planner.SCOPES.items()) + "], lambda k: k IS NOT NULL)"
QUOTE_CLASS = f"[{planner.QUOTES}]"
QUOTED_SQL = f"list_filter(list_transform(regexp_extract_all(question, {quoted(f'{QUOTE_CLASS}(.+?){QUOTE_CLASS}')}, 1), lambda t: {STRIP.format('t')}), lambda t: length(t) > 2 AND length(t) < 80)"
ARTICLES_SQL = "list_transform(regexp_extract_all(question, '(?i)\\barticle\\s+([0-9]{1,3})\\b', 1), lambda n: CAST(n AS INTEGER))"
ANNEXES_SQL = "list_transform(regexp_extract_all(question, '(?i)\\bannex\\s+([IVXLC]+|[0-9]+)\\b', 1), lambda n: 'Annex ' || upper(n))"
SUBJECT_PATTERN = quoted(rf"(?i)\b(?:what|who)\s+(?:is|are)\s+(?:a|an|the)?\s*{QUOTE_CLASS}?(.+?){QUOTE_CLASS}?\s*[?.]?\s*$")
CANDIDATE_SQL = "lower(regexp_replace(" + STRIP.format(f"regexp_extract(question, {SUBJECT_PATTERN}, 1)") + f", {quoted(f'^{QUOTE_CLASS}+|{QUOTE_CLASS}+$')}, '', 'g'))"
PLAN = (
    f"WITH q AS (SELECT query_id, {STRIP.format('question')} AS question FROM ({fixtures.QUESTION_SQL})), "
    f"p0 AS (SELECT *, {TYPE_SQL} AS question_type, {KINDS_SQL} AS doc_kinds, {QUOTED_SQL} AS quoted_terms, {ARTICLES_SQL} AS article_refs, {ANNEXES_SQL} AS annex_refs, {CANDIDATE_SQL} AS candidate FROM q), "
    "plan AS (SELECT query_id, question, question_type, doc_kinds, quoted_terms, article_refs, annex_refs, "
    "CASE question_type WHEN 'definition' THEN ['definition'] WHEN 'obligation' THEN ['obligation'] WHEN 'list' THEN ['list'] WHEN 'condition' THEN ['obligation', 'list'] WHEN 'procedure' THEN ['obligation', 'list'] ELSE [] END AS preferred, "
    "question_type = 'comparison' OR len(doc_kinds) = 2 AS is_comparison, "
    "CASE WHEN question_type = 'definition' THEN CASE WHEN len(quoted_terms) > 0 THEN lower(quoted_terms[1]) WHEN length(candidate) > 2 AND length(candidate) < 60 THEN candidate END END AS subject_term FROM p0)"
)


TURN_PLAN = PLAN.replace(fixtures.QUESTION_SQL, fixtures.TURN_QUESTION_SQL.replace("{turns}", "conversations"))


def plans(spark: SparkSession) -> DataFrame:
    return planner.planned(fixtures.questions(spark))


def turn_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of every turn of the conversations."""
    return planner.planned(fixtures.turn_questions(spark, sf_dir))


@query(TURN_PLAN + " SELECT query_id, question_type, array_to_string(preferred, ',') AS preferred, question_type IN ('definition', 'list') AND NOT is_comparison AS allows_direct_answer FROM plan")
def plan_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_plans(spark, sf_dir).select("query_id", "question_type", F.array_join("preferred_chunk_kinds", ",").alias("preferred"), "allows_direct_answer")


@query(TURN_PLAN + " SELECT query_id, array_to_string(doc_kinds, ',') AS doc_kinds, is_comparison FROM plan")
def plan_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_plans(spark, sf_dir).select("query_id", F.array_join("doc_kinds", ",").alias("doc_kinds"), "is_comparison")


@query(TURN_PLAN + " SELECT query_id, array_to_string(article_refs, ',') AS articles, array_to_string(annex_refs, ',') AS annexes FROM plan")
def plan_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_plans(spark, sf_dir).select("query_id", F.array_join(F.col("article_refs").cast("array<string>"), ",").alias("articles"), F.array_join("annex_refs", ",").alias("annexes"))


@query(TURN_PLAN + " SELECT query_id, array_to_string(quoted_terms, '|') AS quoted FROM plan")
def plan_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_plans(spark, sf_dir).select("query_id", F.array_join("quoted_terms", "|").alias("quoted"))


@query(TURN_PLAN + " SELECT query_id, subject_term FROM plan")
def plan_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_plans(spark, sf_dir).select("query_id", "subject_term")


@query(TURN_PLAN + " SELECT query_id, CASE WHEN question_type IN ('list', 'procedure') THEN 'list' WHEN question_type IN ('obligation', 'condition') THEN 'obligation' ELSE 'answer' END AS prompt FROM plan")
def plan_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_plans(spark, sf_dir).select("query_id", planner.prompt_name(F.col("question_type")).alias("prompt"))


# Retrieval


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All planned questions, with a stored vector as each question's own."""
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 3).cast("bigint").alias("query_id"), F.col("embedding").alias("query_vector"), (F.col("vec_id") % 3).alias("rest"))
    return plans(spark).join(vectors.filter("rest = 0").drop("rest"), "query_id")


def scored_sql(by_kind: bool = False, strict: bool = False, kinds: str = "doc_kinds") -> str:
    scope = "query_id, doc_kind" if by_kind else "query_id"
    inside = f"(len({kinds}) = 0 OR list_contains({kinds}, doc_kind){'' if strict else ' OR NOT any_in'})"
    return (
        PLAN + f", chunk AS ({fixtures.ALL_CHUNK_DUCK}), tk AS (SELECT chunk_id, {tok('content')} AS tokens FROM chunk), "
        f"pl AS (SELECT plan.*, e.embedding AS qv FROM plan JOIN embeddings e ON e.vec_id = plan.query_id * 3), "
        f"pairs AS (SELECT * FROM (SELECT chunk.*, pl.*, bool_or(list_contains({kinds}, doc_kind)) OVER (PARTITION BY query_id) AS any_in FROM chunk, pl) WHERE {inside}), "
        f"st AS (SELECT {scope}, count(*) AS n, avg(len(tokens)) AS a FROM pairs JOIN tk USING (chunk_id) GROUP BY ALL), "
        f"qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tok('question')}) AS term FROM pl) GROUP BY ALL), "
        "ex AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM tk) GROUP BY ALL), "
        "post AS (SELECT pairs.query_id, pairs.doc_kind, pairs.chunk_id, ex.term, ex.tf, qt.times, len(tk.tokens) AS l FROM pairs JOIN ex USING (chunk_id) JOIN qt ON qt.query_id = pairs.query_id AND qt.term = ex.term JOIN tk ON tk.chunk_id = pairs.chunk_id), "
        f"df AS (SELECT {scope}, term, count(*) AS df FROM post GROUP BY ALL), "
        f"kw AS (SELECT query_id, chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS raw FROM post JOIN df USING ({scope}, term) JOIN st USING ({scope}) GROUP BY ALL), "
        f"kn AS (SELECT pairs.*, coalesce(raw / nullif(max(raw) OVER (PARTITION BY {', '.join('pairs.' + c.strip() for c in scope.split(','))}), 0), 0) AS keyword FROM pairs LEFT JOIN kw USING (query_id, chunk_id)), "
        f"sem AS (SELECT kn.*, {COSINE.replace('e.embedding', 'kn.embedding').replace('q.embedding', 'kn.qv')} AS semantic, "
        "least(CASE WHEN list_contains(preferred, chunk_kind) THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(quoted_terms, lambda t: contains(lower(content), lower(t)))) > 0 THEN 0.5::DOUBLE ELSE 0 END, 1) AS structure, "
        "CASE WHEN coalesce(list_contains(article_refs, article_num), false) OR len(list_filter(annex_refs, lambda x: contains(section_path, x))) > 0 THEN 0.5::DOUBLE ELSE 0 END AS bonus FROM kn), "
        "sc AS (SELECT *, 0.6 * semantic + 0.3 * keyword + 0.1 * structure + bonus AS score FROM sem), "
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM sc)"
    )


HITS = "query_id, rank, chunk_id, round(score, 6) AS score, round(semantic, 6) AS semantic_score, round(keyword, 6) AS keyword_score, round(structure, 6) AS structure_score"


def rounded(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = hybrid.scored(asked(spark, sf_dir), fixtures.all_chunks(spark, sf_dir), **options)
    return found.withColumns({c: F.round(c, 6) for c in ("score", "semantic_score", "keyword_score", "structure_score")})


def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    return hybrid.bm25.ranked(found, k, list(by), "chunk_id").withColumn("rank", F.col("rank").cast("bigint"))


SCORES = ("query_id", "rank", "chunk_id", "score", "semantic_score", "keyword_score", "structure_score")


@query(scored_sql() + f" SELECT {HITS} FROM rk WHERE rank <= 6")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(rounded(spark, sf_dir), 6, "query_id").select(*SCORES)


@query(scored_sql(by_kind=True, strict=True) + f" SELECT doc_kind, {HITS} FROM rk WHERE rank <= 3")
def per_kind_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(rounded(spark, sf_dir, strict=True, by_kind=True), 3, "query_id", "doc_kind").select("doc_kind", *SCORES)


@query(
    scored_sql(by_kind=True, strict=True)
    + ", want AS (SELECT query_id, CASE WHEN len(doc_kinds) > 0 THEN doc_kinds ELSE ['mdr', 'ivdr'] END AS kinds FROM pl), got AS (SELECT query_id, list(DISTINCT doc_kind) AS g FROM rk WHERE rank <= 3 GROUP BY query_id) "
    "SELECT query_id, array_to_string(list_filter(kinds, lambda k: list_contains(coalesce(g, []), k)), ',') AS covered, array_to_string(list_filter(kinds, lambda k: NOT list_contains(coalesce(g, []), k)), ',') AS missing FROM want LEFT JOIN got USING (query_id)"
)
def comparison_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranked(rounded(spark, sf_dir, strict=True, by_kind=True), 3, "query_id", "doc_kind")
    own = answer.coverage(plans(spark), hits)
    return own.select("query_id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"))


CONFIDENCE_SQL = (
    ", top AS (SELECT query_id, max(CASE WHEN rank = 1 THEN round(semantic, 6) END) AS s, max(CASE WHEN rank = 1 THEN round(score, 6) END) AS a, max(CASE WHEN rank = 2 THEN round(score, 6) END) AS b, "
    "max(CASE WHEN rank = 1 THEN CASE WHEN len(preferred) = 0 OR list_contains(preferred, chunk_kind) THEN 1 ELSE 0.55 END END)::DOUBLE AS g FROM rk WHERE rank <= 2 GROUP BY query_id), "
    "conf AS (SELECT query_id, round_even(greatest(0, least(1, 0.55 * greatest(0, least(1, s / 0.75)) + 0.25 * greatest(0, least(1, 2.5 * CASE WHEN b IS NULL OR a <= 0 THEN 0.3 ELSE (a - b) / a END)) + 0.2 * g)), 3)::DOUBLE AS confidence FROM top)"
)


def with_plan(hits: DataFrame, spark: SparkSession) -> DataFrame:
    return hits.join(plans(spark).select("query_id", "preferred_chunk_kinds", "allows_direct_answer", "question_type", "subject_term"), "query_id")


@query(scored_sql() + CONFIDENCE_SQL + " SELECT query_id, confidence FROM conf")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.confidence(with_plan(ranked(rounded(spark, sf_dir), 6, "query_id"), spark))


@query(scored_sql() + CONFIDENCE_SQL + " SELECT query_id, confidence, CASE WHEN coalesce(confidence, 0) < 0.35 THEN 'refused' ELSE 'answerable' END AS gate FROM pl LEFT JOIN conf USING (query_id)")
def refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = hybrid.confidence(with_plan(ranked(rounded(spark, sf_dir), 6, "query_id"), spark))
    own = plans(spark).join(sure, "query_id", "left")
    return own.select("query_id", "confidence", F.when(F.coalesce("confidence", F.lit(0.0)) < 0.35, "refused").otherwise("answerable").alias("gate"))


@query(scored_sql() + " SELECT query_id, chunk_id, round(structure, 6) AS structure_score, bonus FROM sc WHERE structure > 0 OR bonus > 0")
def structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure scores and explicit-reference bonuses, without the rest of retrieval."""
    found = hybrid.structure_scores(fixtures.plain_chunks(spark, sf_dir), plans(spark))
    return found.withColumn("structure_score", F.round("structure_score", 6)).filter("structure_score > 0 or bonus > 0")


def scope_sql(strict: bool) -> str:
    return (
        f"WITH chunk AS ({fixtures.ALL_CHUNK_DUCK}), w AS (SELECT * FROM (VALUES (1, ['mdr']), (2, ['zz']), (3, []), (4, ['zz', 'ivdr'])) AS t(query_id, kinds)), "
        "m AS (SELECT w.query_id, chunk_id, len(kinds) = 0 OR list_contains(kinds, doc_kind) AS ok FROM chunk, w), "
        "a AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_in FROM m) "
        f"SELECT CAST(query_id AS BIGINT) AS query_id, count(*) AS n, CAST(sum(chunk_id) AS BIGINT) AS ids FROM a WHERE ok {'' if strict else 'OR NOT any_in'} GROUP BY query_id"
    )


def scoped(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    wanted = spark.sql("SELECT * FROM VALUES (1L, array('mdr')), (2L, array('zz')), (3L, cast(array() as array<string>)), (4L, array('zz', 'ivdr')) AS t(query_id, kinds)")
    pairs = fixtures.plain_chunks(spark, sf_dir).select("chunk_id", "doc_kind").crossJoin(F.broadcast(wanted))
    return hybrid.in_scope(pairs, F.col("kinds"), F.col("doc_kind"), strict).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))


@query(scope_sql(False))
def scope_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(spark, sf_dir, False)


@query(scope_sql(True))
def scope_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(spark, sf_dir, True)


# Context and answers

CITATION_SQL = (
    "concat_ws(', ', coalesce(nullif(short_label, ''), filename), coalesce(CASE WHEN article_num IS NOT NULL THEN 'Article ' || article_num || coalesce('(' || nullif(paragraph, '') || ')', '') END, nullif(section_path, '')), CASE WHEN page <> 0 THEN 'p. ' || page END)"
)
CUT_SQL = f"cut AS (SELECT query_id, rank, chunk_id, document_id, article_num, {CITATION_SQL} AS citation, content, sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM rk WHERE rank <= 6), prim AS (SELECT * FROM cut WHERE used <= 7000 OR rank = 1)"
SIBLING_CITATION_SQL = "regexp_replace(coalesce(nullif(short_label, ''), filename, '') || ', ' || coalesce(article, '') || coalesce('(' || nullif(paragraph, '') || ')', ''), '^[, ]+|[, ]+$', '', 'g')"


def sibling_sql(number: int, before: str) -> str:
    return (
        f"s{number} AS (SELECT query_id, chunk_id, citation, content, true AS expanded, {number * 1_000_000_000} + chunk_index AS ord, used FROM (SELECT h.query_id, c.chunk_id, c.chunk_index, {SIBLING_CITATION_SQL.replace('short_label', 'c.short_label').replace('filename', 'c.filename').replace('(article', '(c.article').replace('paragraph', 'c.paragraph')} AS citation, c.content, "
        f"spent + sum(length(c.content)) OVER (PARTITION BY h.query_id ORDER BY c.chunk_index, c.chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM cut h JOIN chunk c ON c.document_id = h.document_id AND c.article_num = h.article_num "
        f"JOIN (SELECT query_id, max(used) AS spent FROM {before} GROUP BY query_id) b ON b.query_id = h.query_id WHERE h.rank = {number} AND NOT EXISTS (SELECT 1 FROM {before} x WHERE x.query_id = h.query_id AND x.chunk_id = c.chunk_id)) WHERE used <= 7000), "
        f"e{number} AS (SELECT * FROM {before} UNION ALL SELECT * FROM s{number})"
    )


EXPANDED = f"{CUT_SQL}, e0 AS (SELECT query_id, chunk_id, citation, content, false AS expanded, rank AS ord, used FROM prim), {sibling_sql(1, 'e0')}, {sibling_sql(2, 'e1')}"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(answer.cited(hybrid.with_chunks(ranked(rounded(spark, sf_dir), 6, "query_id"), fixtures.plain_chunks(spark, sf_dir))))


@query(scored_sql() + f", {CUT_SQL} SELECT query_id, rank, chunk_id, citation, CAST(used AS BIGINT) AS used FROM prim")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.primary(hits(spark, sf_dir)).select("query_id", "rank", "chunk_id", "citation", "used")


@query(scored_sql() + f", {EXPANDED} SELECT query_id, chunk_id, citation, expanded, CAST(ord AS BIGINT) AS ord, CAST(used AS BIGINT) AS used FROM e2")
def sibling_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.expanded(hits(spark, sf_dir), fixtures.plain_chunks(spark, sf_dir)).select("query_id", "chunk_id", "citation", "expanded", "ord", "used")


@query(scored_sql() + f", {EXPANDED} SELECT query_id, string_agg('[' || citation || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS context FROM e2 GROUP BY query_id")
def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.rendered(context.expanded(hits(spark, sf_dir), fixtures.plain_chunks(spark, sf_dir)), "query_id")


#: The term that a question on a document asks for: one it defines, one that it only refers to, one it lacks, or none.
SUBJECT_SQL = "CASE document_id % 4 WHEN 0 THEN 'device ' || CAST(document_id % 9 AS STRING) WHEN 1 THEN 'unit' WHEN 2 THEN 'nothing' END"


@query(
    BLOCKS + f", d AS (SELECT document_id AS query_id, block_no AS rank, text AS content, {SUBJECT_SQL} AS subject_term FROM blocks WHERE kind = 'definition'), "
    f"f AS (SELECT * FROM d WHERE NOT ({REDIRECT_SQL.replace('(text', '(content')}) AND (subject_term IS NULL OR {DEFINED_SQL.replace('(text', '(content')} = subject_term)) "
    "SELECT query_id, arg_min(content, rank) || chr(10) || chr(10) || '[MDR]' AS direct FROM f GROUP BY query_id"
)
def direct_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition that answers a question on each document, out of all its definitions in order."""
    rows = all_blocks(spark, sf_dir).filter("kind = 'definition'")
    own = rows.select(F.col("document_id").alias("query_id"), F.col("block_no").alias("rank"), F.col("text").alias("content"), F.expr(SUBJECT_SQL).alias("subject_term"))
    return answer.picked_definition(own.withColumns({"chunk_kind": F.lit("definition"), "citation": F.lit("MDR")}))


@query()
def answer_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to all questions: both models stand-ins, retrieval over hash embeddings of the chunks."""
    embedded = settled(fixtures.plain_chunks(spark, sf_dir).withColumn("embedding", HashEmbedder().as_column(F.col("content"))))  # once, not for each question
    own = answer.answer(fixtures.questions(spark), embedded)
    return own.select("query_id", "question_type", "mode", "answer_path", "answer", "confidence", F.size("sources").alias("n_sources"), F.array_join("warnings", ",").alias("warnings"))


LABEL_SQL = "[" + ", ".join(quoted(x) for x in fixtures.LABELS) + "]"
LOWERED = "[" + ", ".join(quoted(x.lower()) for x in fixtures.LABELS) + "]"
CITED_SQL = f"list_transform(regexp_extract_all(answer, '\\[([^\\]]+)\\]', 1), lambda c: {STRIP.format('c')})"
UNSUPPORTED_SQL = f"len(list_filter(list_transform({CITED_SQL}, lambda c: lower(c)), lambda c: len(list_filter({LOWERED}, lambda k: starts_with(k, substr(c, 1, 12)) OR starts_with(c, substr(k, 1, 12)))) = 0)) > 0"
REFUSED_SQL = f"regexp_matches(lower(answer), {quoted('|'.join(text.REFUSALS))})"
LONG_SQL = f"list_filter(list_transform(regexp_split_to_array(lower(answer), '[.\\n]+'), lambda s: {STRIP.format('s')}), lambda s: length(s) > 25)"
DEGENERATE_SQL = f"(len({LONG_SQL}) >= 4 AND len(list_distinct({LONG_SQL})) / greatest(len({LONG_SQL}), 1) < 0.5)"
TURNS = "WITH a AS (SELECT conv_id * 1000 + turn AS query_id, CASE WHEN turn % 3 = 0 THEN text || ' [MDR] and [' || role || ' 12345678901]' WHEN turn % 3 = 1 THEN repeat(text || '. ', 5) ELSE CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE text || ' Cannot answer.' END END AS answer, 0.1 * (turn % 10) AS confidence FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TURNS.removeprefix("WITH a AS (").removesuffix(")").replace("FROM conversations", "FROM {t}"), t=table(spark, sf_dir, "conversations"))


def labels():
    return F.array(*(F.lit(x) for x in fixtures.LABELS))


@query(f"{TURNS} SELECT query_id, array_to_string({CITED_SQL}, '|') AS citations FROM a")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("query_id", F.array_join(text.citations(F.col("answer")), "|").alias("citations"))


@query(f"{TURNS} SELECT query_id, {UNSUPPORTED_SQL} AS unsupported FROM a")
def unsupported_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("query_id", text.has_unsupported_citation(F.col("answer"), labels()).alias("unsupported"))


@query(f"{TURNS} SELECT query_id, {REFUSED_SQL} AS refusal FROM a")
def refusal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("query_id", text.is_refusal(F.col("answer")).alias("refusal"))


@query(f"{TURNS} SELECT query_id, {DEGENERATE_SQL} AS degenerate FROM a")
def degenerate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("query_id", text.is_degenerate(F.col("answer")).alias("degenerate"))


@query(
    f"{TURNS}, s AS (SELECT query_id, {STRIP.format('answer')} AS answer, confidence FROM a), v AS (SELECT *, answer = '' AS blank, {DEGENERATE_SQL} AS bad, {UNSUPPORTED_SQL} AS cites, "
    f"confidence < 0.35 AND NOT contains(lower(answer), {quoted(text.NO_ANSWER.lower())}) AS low FROM s) "
    f"SELECT query_id, CASE WHEN blank OR bad THEN {quoted(text.NO_ANSWER)} ELSE answer END AS answer, CASE WHEN blank THEN 'empty answer' WHEN bad THEN 'repetitive answer' ELSE concat_ws(',', CASE WHEN cites THEN 'unsupported citation' END, CASE WHEN low THEN 'low confidence' END) END AS warnings FROM v"
)
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = turns(spark, sf_dir).select("query_id", text.validated(F.col("answer"), labels(), F.col("confidence")).alias("v"))
    return own.select("query_id", "v.answer", F.array_join("v.warnings", ",").alias("warnings"))


# Sentences and highlights

PIECE_SQL = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.;:])\\s+([A-Z(0-9])', '\\1' || chr(30) || '\\2', 'g'), '[\\n' || chr(30) || ']+'), lambda p: " + STRIP.format("p") + "), lambda p: p <> '')"


#: Breaks and pieces in turn: a break between chr(30) and chr(31) is as long as what stands between.
PARTS_SQL = "regexp_extract_all(regexp_replace(text, '([.;:])(\\s+)([A-Z(0-9])', '\\1' || chr(30) || '\\2' || chr(31) || '\\3', 'g'), chr(30) || '[^' || chr(31) || ']*' || chr(31) || '|\\n+|[^' || chr(30) || '\\n]+')"
OFFSETS_SQL = (
    f"parts AS (SELECT doc_id, unnest({PARTS_SQL}) AS part, unnest(range(len({PARTS_SQL}))) AS no FROM documents), "
    "placed AS (SELECT *, sum(length(part) - CASE WHEN starts_with(part, chr(30)) THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) - length(part) AS pos FROM parts), "
    f"spans AS (SELECT doc_id, no, CAST(pos + length(part) - length(regexp_replace(part, '^\\s+', '')) AS BIGINT) AS start, length({STRIP.format('part')}) AS size FROM placed WHERE NOT starts_with(part, chr(30)) AND {STRIP.format('part')} <> ''), "
    "offsets AS (SELECT doc_id, string_agg(start || ':' || (start + size), ',' ORDER BY no) AS places FROM spans GROUP BY doc_id)"
)


@query(f"WITH {OFFSETS_SQL} SELECT doc_id, CAST(len({PIECE_SQL}) AS BIGINT) AS n, md5(array_to_string({PIECE_SQL}, '|')) AS digest, coalesce(places, '') AS places FROM documents LEFT JOIN offsets USING (doc_id)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    joined = F.array_join(F.transform("s", lambda s: s["sentence"]), "|")
    places = F.array_join(F.transform("s", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return own.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(joined).alias("digest"), places.alias("places"))


TURN_PIECES = f"WITH c AS (SELECT conv_id, turn, text FROM conversations), a AS (SELECT conv_id, arg_min(text, turn) AS answer FROM c GROUP BY conv_id), p AS (SELECT conv_id, turn, unnest({PIECE_SQL}) AS sentence, unnest(range(len({PIECE_SQL}))) AS no FROM c)"
OVERLAP_SQL = f", o AS (SELECT p.*, len(list_intersect(list_distinct({tok('sentence')}), list_distinct({tok('answer')}))) / greatest(len(list_distinct({tok('sentence')})), 6) AS score FROM p JOIN a USING (conv_id))"


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn beside its conversation's first, which stands in for the answer."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    first = own.groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    return own.join(first, "conv_id")


@query(TURN_PIECES + OVERLAP_SQL + " SELECT conv_id, turn, CAST(no AS BIGINT) AS no, round(score, 6) AS score FROM o")
def overlap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_answers(spark, sf_dir).select("conv_id", "turn", F.array_distinct(text.tokens(F.col("answer"))).alias("words"), F.posexplode(text.sentences(F.col("text"))).alias("no", "s"))
    return own.select("conv_id", "turn", F.col("no").cast("bigint").alias("no"), F.round(text.overlap(F.col("s.sentence"), F.col("words")), 6).alias("score"))


@query(
    TURN_PIECES + OVERLAP_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, no) AS r FROM o WHERE score >= 0.34) "
    "SELECT conv_id, turn, string_agg(CAST(length(sentence) AS VARCHAR), ',' ORDER BY no) AS lengths FROM k WHERE r <= 3 GROUP BY ALL"
)
def top3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_answers(spark, sf_dir).select("conv_id", "turn", text.supporting_spans(F.col("text"), F.col("answer")).alias("spans"))
    lengths = F.array_join(F.transform("spans", lambda s: (s["end"] - s["start"]).cast("string")), ",")
    return own.filter(F.size("spans") > 0).select("conv_id", "turn", lengths.alias("lengths"))


@query(
    "WITH s AS (SELECT CAST(floor(event_id / 40) AS BIGINT) AS id, event_id, CAST(event_id % 97 AS INTEGER) AS s, CAST(event_id % 97 + 3 + event_id % 11 AS INTEGER) AS e FROM events), "
    "m AS (SELECT *, coalesce(max(least(e, 90)) OVER (PARTITION BY id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM s) "
    "SELECT CAST(id AS BIGINT) AS id, greatest(s, covered) AS start, least(e, 90) AS stop FROM m WHERE greatest(s, covered) < least(e, 90)"
)
def span_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights cut to a text of 90 characters and to what earlier ones leave; forty events each stand in for a text's spans."""
    own = table(spark, sf_dir, "events").selectExpr("CAST(floor(event_id / 40) AS BIGINT) AS id", "CAST(event_id % 97 AS INT) AS start", "CAST(event_id % 97 + 3 + event_id % 11 AS INT) AS end")
    spans = own.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return spans.select("id", F.explode(text.clamped_spans(F.col("spans"), F.lit(90))).alias("s")).select("id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query(
    f"WITH c AS ({fixtures.ALL_CHUNK_DUCK}) SELECT chunk_id, {CITATION_SQL} AS citation, {SIBLING_CITATION_SQL} AS sibling FROM c"
)
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = answer.cited(fixtures.plain_chunks(spark, sf_dir))
    return own.select("chunk_id", "citation", structure.sibling_citation(F.col("short_label"), F.col("filename"), F.col("article"), F.col("paragraph")).alias("sibling"))
