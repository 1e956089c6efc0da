"""Queries on legal structure, chunks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structure as fn
from ..operators import chunking, structure
from . import fixtures
from .registry import query, quoted, table

ORDER = ("page", "line_no")
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def matches(kind: str) -> str:
    return f"regexp_matches(line, {quoted(fn.LINE_TYPES[kind])})"


def group(kind: str, number: int = 1) -> str:
    return f"regexp_extract(line, {quoted(fn.LINE_TYPES[kind])}, {number})"


CLEAN = (
    f"WITH raw AS ({fixtures.LEGAL_DUCK}), stripped AS (SELECT document_id, page, line_no, regexp_replace(line, '\\s+$', '') AS line FROM raw), "
    f"clean AS (SELECT * FROM stripped WHERE line <> '' AND NOT regexp_matches(line, {quoted(fn.NOISE)}))"
)
TYPE_CASE = "CASE " + " ".join(f"WHEN {matches(k)} THEN '{k}'" for k in fn.LINE_TYPES) + " ELSE 'text' END"
W = "(PARTITION BY document_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)"
TYPED = (
    CLEAN + f", t0 AS (SELECT *, {TYPE_CASE} AS lt FROM clean), "
    f"t1 AS (SELECT *, lt IN ('annex', 'chapter', 'section', 'article', 'article_inline') AS head, sum(CASE WHEN lt IN ('article', 'article_inline') THEN 1 ELSE 0 END) OVER {W} AS epoch, "
    f"last_value(CASE WHEN lt IN ('article', 'article_inline') THEN lt END IGNORE NULLS) OVER {W} AS opener FROM t0), "
    "t2 AS (SELECT *, sum(CASE WHEN head THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, epoch ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS nth FROM t1), "
    f"typed AS (SELECT document_id, page, line_no, line, CASE WHEN NOT head AND nth = 1 AND opener = 'article' AND length(line) < 200 AND NOT {matches('paragraph')} AND NOT regexp_matches(line, {quoted(fn.POINT)}) THEN 'title' ELSE lt END AS ltype FROM t2)"
)
NUMBER = f"CAST(CASE WHEN ltype = 'article' THEN {group('article')} ELSE {group('article_inline')} END AS INTEGER)"


def carry_column(name: str, sets: str, clears: str) -> str:
    return f"(last_value(CASE WHEN ltype IN ({clears}) THEN struct_pack(v := CAST(NULL AS VARCHAR)) {sets} END IGNORE NULLS) OVER {W}).v AS {name}"


def put(kinds: str, value: str) -> str:
    return f"WHEN ltype IN ({kinds}) THEN struct_pack(v := CAST({value} AS VARCHAR))"


ART = "'article', 'article_inline'"
STATE = (
    TYPED + ", state AS (SELECT *, "
    + ", ".join(
        [
            carry_column("annex", put("'annex'", f"'Annex ' || upper({group('annex')})"), ART),
            carry_column("chapter", put("'chapter'", f"'Chapter ' || upper({group('chapter')})"), "'annex'"),
            carry_column("section", put("'section'", f"'Section ' || {group('section')}"), "'annex', 'chapter'"),
            carry_column("article", put(ART, f"'Article ' || {NUMBER}"), "'annex'"),
            carry_column("num", put(ART, NUMBER), "'annex'"),
            carry_column("heading", put("'article_inline'", STRIP.format(group("article_inline", 2))) + " " + put("'title'", STRIP.format("line")), "'annex', 'article'"),
            carry_column("paragraph", put("'definition'", group("definition")) + " " + put("'paragraph'", group("paragraph")) + " " + put("'bare'", group("bare")), f"'annex', 'chapter', 'section', {ART}"),
        ]
    )
    + f", CAST(sum(CASE WHEN ltype IN ('annex', 'chapter', 'section', {ART}, 'definition', 'paragraph', 'bare') THEN 1 ELSE 0 END) OVER {W} AS BIGINT) AS block_no FROM typed)"
)
BLOCKS = (
    STATE + ", b0 AS (SELECT document_id, block_no, string_agg(CASE WHEN ltype NOT IN ('annex', 'chapter', 'section', 'article', 'article_inline', 'title') THEN "
    + STRIP.format("line")
    + " END, chr(10) ORDER BY page, line_no) AS txt, min(page) AS page, arg_min(struct_pack(a := annex, c := chapter, s := section, r := article, n := num, p := paragraph, t := ltype), line_no) AS f, arg_max(struct_pack(h := heading), line_no).h AS heading FROM state GROUP BY ALL), "
    "blocks AS (SELECT document_id, block_no, txt AS text, page, f.c AS chapter, f.s AS section, f.r AS article, CAST(f.n AS INTEGER) AS article_num, f.p AS paragraph, f.a AS annex, heading, "
    "concat_ws(' > ', f.a, f.c, f.s, f.r) AS section_path, CASE WHEN f.t = 'definition' THEN 'definition' WHEN f.a IS NOT NULL THEN 'annex' WHEN length(txt) - length(replace(txt, chr(10) || '(', chr(10))) >= 2 THEN 'list' "
    "WHEN regexp_matches(txt, '(?i)\\b(shall|must|are required to|is required to)\\b') THEN 'obligation' ELSE 'body' END AS kind FROM b0 WHERE txt <> '')"
)


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.clean(fixtures.legal_lines(spark, sf_dir))


def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.typed(clean_lines(spark, sf_dir))


def all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.blocks(structure.carried(typed_lines(spark, sf_dir)))


@query(CLEAN + " SELECT document_id, CAST(line_no AS BIGINT) AS line_no, line FROM clean")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(spark, sf_dir).select("document_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(TYPED + " SELECT document_id, CAST(line_no AS BIGINT) AS line_no, ltype FROM typed")
def line_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_lines(spark, sf_dir).select("document_id", F.col("line_no").cast("bigint").alias("line_no"), "ltype")


@query(STATE + " SELECT document_id, CAST(line_no AS BIGINT) AS line_no, annex, chapter, section, article, CAST(num AS INTEGER) AS article_num, paragraph, block_no FROM state")
def structure_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = structure.carried(typed_lines(spark, sf_dir))
    return own.select("document_id", F.col("line_no").cast("bigint").alias("line_no"), "annex", "chapter", "section", "article", "article_num", "paragraph", F.col("block_no").cast("bigint").alias("block_no"))


@query(STATE + " SELECT document_id, CAST(line_no AS BIGINT) AS line_no, ltype, article, heading FROM state WHERE ltype IN ('title', 'article', 'article_inline')")
def article_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = structure.carried(typed_lines(spark, sf_dir)).filter(F.col("ltype").isin("title", "article", "article_inline"))
    return own.select("document_id", F.col("line_no").cast("bigint").alias("line_no"), "ltype", "article", "heading")


@query(BLOCKS + " SELECT document_id, block_no, text, page, chapter, section, article, article_num, paragraph, annex, heading, section_path FROM blocks")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = all_blocks(spark, sf_dir)
    return own.select("document_id", F.col("block_no").cast("bigint").alias("block_no"), "text", "page", "chapter", "section", "article", "article_num", "paragraph", "annex", "heading", "section_path")


@query(BLOCKS + " SELECT kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY kind")
def block_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_blocks(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(TYPED + f" SELECT document_id, count(DISTINCT {NUMBER}) AS article_count FROM typed WHERE ltype IN ({ART}) GROUP BY document_id")
def article_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.article_counts(typed_lines(spark, sf_dir))


KIND_TEXT = """CASE doc_id % 8 WHEN 0 THEN 'REGULATION (EU) 2017/745 OF THE EUROPEAN PARLIAMENT' || chr(10) || text WHEN 1 THEN 'regulation  (eu) 2017/746 of the European Parliament, citing 2017/745 ' || text
 WHEN 2 THEN 'Regulation (EU) 2016/679 OF THE EUROPEAN PARLIAMENT ' || text WHEN 3 THEN text || ' see 2017/746 and then 2017/745' WHEN 4 THEN 'Directive (EU) 2001/83' || chr(10) || 'Article 1' || chr(10) || text
 WHEN 5 THEN text || chr(10) || ' article 7 of it' WHEN 6 THEN 'as 2017/745 and 2017/746 say ' || text ELSE text END"""
KNOWN_SQL = (
    f"WITH h AS (SELECT doc_id, substr({KIND_TEXT}, 1, {fn.HEAD_CHARS}) AS head FROM documents), "
    f"n AS (SELECT *, regexp_extract(head, {quoted(fn.SELF_TITLE.replace('(?iU)', '(?i)'))}, 1) AS num, nullif(strpos(head, '2017/745'), 0) AS p5, nullif(strpos(head, '2017/746'), 0) AS p6 FROM h) "
    "SELECT doc_id, CASE WHEN num = '2017/745' THEN 'mdr' WHEN num = '2017/746' THEN 'ivdr' WHEN num <> '' THEN 'regulation' WHEN p5 = least(p5, p6) THEN 'mdr' WHEN p6 = least(p5, p6) THEN 'ivdr' "
    "WHEN regexp_matches(head, '(?im)^\\s*Article\\s+\\d+') THEN 'regulation' ELSE 'general' END AS doc_kind, "
    "CASE WHEN num = '2017/745' THEN 'MDR' WHEN num = '2017/746' THEN 'IVDR' WHEN num <> '' THEN num WHEN p5 = least(p5, p6) THEN 'MDR' WHEN p6 = least(p5, p6) THEN 'IVDR' "
    f"WHEN regexp_matches(head, '(?im)^\\s*Article\\s+\\d+') THEN nullif(regexp_extract(head, {quoted(fn.OTHER_TITLE.replace('(?iU)', '(?i)'))}, 1), '') END AS short_label FROM n"
)


@query(KNOWN_SQL)
def doc_kind_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.expr(KIND_TEXT).alias("text")).select("doc_id", fn.document_kind(F.col("text")).alias("k"))
    return own.select("doc_id", F.col("k.kind").alias("doc_kind"), F.col("k.label").alias("short_label"))


DEFINED_SQL = "nullif(lower(" + STRIP.format(f"regexp_extract(text, {quoted(fn.DEFINED.replace('(?iU)', '(?i)'))}, 1)") + "), '')"
REDIRECT_SQL = f"length(text) <= 320 AND regexp_matches(text, {quoted(fn.REDIRECT.replace('(?isU)', '(?is)'))})"


@query(BLOCKS + f" SELECT document_id, block_no, {DEFINED_SQL} AS term FROM blocks WHERE kind = 'definition'")
def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = all_blocks(spark, sf_dir).filter("kind = 'definition'")
    return own.select("document_id", F.col("block_no").cast("bigint").alias("block_no"), fn.defined_term(F.col("text")).alias("term"))


@query(BLOCKS + f" SELECT document_id, block_no FROM blocks WHERE kind = 'definition' AND {REDIRECT_SQL}")
def xref_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = all_blocks(spark, sf_dir).filter((F.col("kind") == "definition") & fn.is_redirect(F.col("text")))
    return own.select("document_id", F.col("block_no").cast("bigint").alias("block_no"))


PIECES = (
    "WITH RECURSIVE cut AS (SELECT doc_id, text, 0 AS piece_no, 0 AS start, 0 AS stop FROM documents WHERE length(text) > 1600 UNION ALL "
    "SELECT doc_id, text, piece_no + 1, s, e FROM (SELECT *, CASE WHEN s + 1600 >= length(text) THEN length(text) "
    "WHEN length(w) - p2 - 1 > 800 AND p2 > 0 THEN s + length(w) - p2 + 1 WHEN length(w) - p1 > 800 AND p1 > 0 THEN s + length(w) - p1 + 1 WHEN length(w) - p3 - 1 > 800 AND p3 > 0 THEN s + length(w) - p3 + 1 ELSE s + 1600 END AS e "
    "FROM (SELECT *, strpos(reverse(w), chr(10) || chr(10)) AS p2, strpos(reverse(w), chr(10)) AS p1, strpos(reverse(w), ' .') AS p3 FROM (SELECT *, substr(text, s + 1, 1600) AS w FROM "
    "(SELECT *, CASE WHEN piece_no = 0 THEN 0 ELSE greatest(stop - 200, start + 1) END AS s FROM cut WHERE piece_no = 0 OR stop < length(text))))))"
    " SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece_no) - 1 AS piece_no, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, piece_no, " + STRIP.format("substr(text, start + 1, stop - start)") + " AS t FROM cut WHERE piece_no > 0) WHERE t <> ''"
    " UNION ALL SELECT doc_id, 0, length(text), md5(text) FROM documents WHERE length(text) <= 1600"
)


@query(PIECES)
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    cut = chunking.split_blocks(own)
    return cut.select("document_id", F.col("piece_no").cast("bigint").alias("piece_no"), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


MERGED = (
    BLOCKS.replace("WITH ", "WITH RECURSIVE ", 1) + f", kept AS (SELECT * FROM blocks WHERE length({STRIP.format('text')}) >= 15), "
    "cut AS (SELECT document_id, block_no, text, 0 AS piece_no, 0 AS start, 0 AS stop FROM kept WHERE length(text) > 1600 UNION ALL "
    "SELECT document_id, block_no, text, piece_no + 1, s, e FROM (SELECT *, CASE WHEN s + 1600 >= length(text) THEN length(text) "
    "WHEN length(w) - p2 - 1 > 800 AND p2 > 0 THEN s + length(w) - p2 + 1 WHEN length(w) - p1 > 800 AND p1 > 0 THEN s + length(w) - p1 + 1 WHEN length(w) - p3 - 1 > 800 AND p3 > 0 THEN s + length(w) - p3 + 1 ELSE s + 1600 END AS e "
    "FROM (SELECT *, strpos(reverse(w), chr(10) || chr(10)) AS p2, strpos(reverse(w), chr(10)) AS p1, strpos(reverse(w), ' .') AS p3 FROM (SELECT *, substr(text, s + 1, 1600) AS w FROM "
    "(SELECT *, CASE WHEN piece_no = 0 THEN 0 ELSE greatest(stop - 200, start + 1) END AS s FROM cut WHERE piece_no = 0 OR stop < length(text)))))), "
    "pieces AS (SELECT * FROM (SELECT document_id, block_no, piece_no, " + STRIP.format("substr(text, start + 1, stop - start)") + " AS text FROM cut WHERE piece_no > 0) WHERE text <> '' UNION ALL SELECT document_id, block_no, 0, text FROM kept WHERE length(text) <= 1600), "
    "ranked AS (SELECT p.document_id, p.text, k.kind, k.article_num, k.annex, row_number() OVER (PARTITION BY p.document_id ORDER BY p.block_no, p.piece_no) AS n FROM pieces p JOIN kept k ON k.document_id = p.document_id AND k.block_no = p.block_no), "
    "fold AS (SELECT document_id, n, text, kind, article_num, annex, 0 AS chunk_index FROM ranked WHERE n = 1 UNION ALL "
    "SELECT document_id, n, CASE WHEN fits THEN before || chr(10) || text ELSE text END, CASE WHEN fits AND last <> 'body' THEN last ELSE kind END, article_num, annex, chunk_index + CASE WHEN fits THEN 0 ELSE 1 END FROM "
    "(SELECT r.*, f.text AS before, f.kind AS last, f.chunk_index, r.article_num IS NOT DISTINCT FROM f.article_num AND r.annex IS NOT DISTINCT FROM f.annex AND r.kind <> 'definition' AND f.kind <> 'definition' AND length(f.text) + length(r.text) + 1 <= 1600 AS fits "
    "FROM fold f JOIN ranked r ON r.document_id = f.document_id AND r.n = f.n + 1)) "
    "SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, arg_max(article_num, n) AS article_num, arg_max(kind, n) AS chunk_kind, CAST(max_by(length(text), n) AS BIGINT) AS n_chars, md5(arg_max(text, n)) AS digest FROM fold GROUP BY document_id, chunk_index"
)


@query(MERGED)
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents; each merge depends on the last."""
    own = chunking.build_chunks(all_blocks(spark, sf_dir))
    return own.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "article_num", "chunk_kind", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


@query(
    BLOCKS + " SELECT document_id, count(*) AS n_blocks, count(DISTINCT chapter) AS n_chapters, count(DISTINCT annex) AS n_annexes, count(DISTINCT article_num) AS n_articles, "
    "CAST(coalesce(sum(CASE WHEN article_num = 10 THEN length(text) END), 0) AS BIGINT) AS article_10_chars FROM blocks GROUP BY document_id"
)
def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.structure_report(all_blocks(spark, sf_dir))


@query(BLOCKS + " SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY block_no) - 1 AS chunk_index, md5(text) AS digest FROM blocks WHERE length(text) >= 15")
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.numbered(chunking.kept_blocks(all_blocks(spark, sf_dir)).withColumn("piece_no", F.lit(0)))
    return own.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("content").alias("digest"))


@query(BLOCKS + " SELECT document_id, kind, count(*) AS n FROM blocks GROUP BY ALL")
def kinds_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_blocks(spark, sf_dir).groupBy("document_id", "kind").agg(F.count("*").alias("n"))


@query(
    BLOCKS + " SELECT document_id, count(*) AS n_chunks, count(DISTINCT article_num) AS n_articles, CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(floor(avg(length(text))) AS BIGINT) AS avg_chars, CAST(max(length(text)) AS BIGINT) AS max_chars, "
    "round(100.0::DOUBLE * count(article_num) / count(*), 6) AS article_coverage, round(100.0::DOUBLE * count(paragraph) / count(*), 6) AS paragraph_coverage FROM blocks WHERE length(text) >= 15 GROUP BY document_id"
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.numbered(chunking.kept_blocks(all_blocks(spark, sf_dir)).withColumn("piece_no", F.lit(0)))
    return chunking.report(own).withColumn("article_coverage", F.col("article_coverage").cast("double")).withColumn("paragraph_coverage", F.col("paragraph_coverage").cast("double"))
