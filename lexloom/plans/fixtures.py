"""Inputs that the synthetic tables lack, derived by SQL that Spark and DuckDB share: legal lines, questions, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import quoted, table

QUESTIONS = (
    "What are the obligations of manufacturers under Article 10 of the MDR?",
    "What is a 'medical device'?",
    "Who is an authorised representative?",
    "What is an importer?",
    "Compare the clinical evaluation in MDR and IVDR",
    "List all the documents for Annex II and Annex XIV",
    "When does Article 120 apply?",
    "How to register a device according to Article 29?",
    "Summarise chapter two of 2017/746",
    "Who must keep records of in vitro diagnostic devices?",
    "What does placing on the market mean?",
    "Is the manufacturer's file the importer's duty",
    "Under what conditions are devices exempt?",
    "Give an overview of both regulations",
    "Which documents and records are required for approval?",
    "Enumerate the steps; see article 5 and ARTICLE 7",
    "Explain the medical device regulation vs. 2017/746",
    "The weather in the mountains",
    "what are articles?",
    "   What is the definition of \"performance study\"?   ",
)

LABELS = ("MDR, Article 2(1), p. 4", "MDR", "IVDR", "IVDR, Annex II")

K = "(document_id + line_no) % 24"
NUM = "CAST(1 + (document_id * 3 + line_no) % 40 AS STRING)"
LINE_CASE = f"""CASE {K}
 WHEN 0 THEN 'CHAPTER ' || CAST(1 + line_no % 7 AS STRING)
 WHEN 1 THEN 'Section ' || CASE WHEN document_id % 2 = 0 THEN 'iv' ELSE '3' END
 WHEN 2 THEN 'Article ' || {NUM}
 WHEN 4 THEN '1. ' || raw
 WHEN 5 THEN '(a) ' || raw
 WHEN 6 THEN '(b) ' || raw
 WHEN 7 THEN '(c) ' || raw
 WHEN 8 THEN '2.'
 WHEN 9 THEN raw || ' shall apply'
 WHEN 10 THEN CASE document_id % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'L 117/5' WHEN 2 THEN CAST(line_no AS STRING) ELSE ' 5.5.2017 ' END
 WHEN 11 THEN 'Article ' || {NUM} || 'a Obligations of operators'
 WHEN 12 THEN '(1) ''device ' || CAST(document_id % 9 AS STRING) || ''' means ' || raw
 WHEN 13 THEN '(2) “unit” means a unit as defined in point (1) of Article 2 of Regulation (EU) 2017/745'
 WHEN 15 THEN 'annex ' || CASE WHEN document_id % 3 = 0 THEN 'iv' ELSE '2' END
 WHEN 17 THEN 'Article 10 of this Regulation applies'
 WHEN 18 THEN '3. ' || raw || ' must hold'
 WHEN 19 THEN 'official journal of the european union'
 WHEN 20 THEN 'ARTICLE ' || {NUM} || ' b  '
 WHEN 21 THEN '3.'
 ELSE raw END"""
LEGAL_SPARK = f"SELECT document_id, CAST(1 + line_no DIV 30 AS INT) AS page, line_no, {LINE_CASE} AS line FROM (SELECT doc_id AS document_id, posexplode(split(text, '\\n')) AS (line_no, raw) FROM {{docs}})"
LEGAL_DUCK = f"SELECT document_id, CAST(1 + line_no // 30 AS INTEGER) AS page, line_no, {LINE_CASE} AS line FROM (SELECT doc_id AS document_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"


def values(rows: list[tuple], names: str) -> str:
    def literal(v) -> str:
        return quoted(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(literal(v) for v in r) + ')' for r in rows)}) AS t({names})"


QUESTION_SQL = values([(i, q) for i, q in enumerate(QUESTIONS)], "query_id, question")
#: Turns of conversations as questions: one of the questions above alone, before the turn's text, or after it.
TURN_QUESTION_SQL = (
    "SELECT query_id, CASE turn % 3 WHEN 0 THEN asked WHEN 1 THEN asked || ' ' || text ELSE text || ' ' || asked END AS question FROM (SELECT conv_id * 1000 + turn AS query_id, turn, text, CASE (conv_id * 7 + turn) % 20 "
    + " ".join(f"WHEN {i} THEN {quoted(q)}" for i, q in enumerate(QUESTIONS))
    + " END AS asked FROM {turns})"
)
#: Documents as files that are uploaded: names and sizes that rules reject stand in by position.
UPLOAD_SQL = (
    "SELECT doc_id AS upload_id, CASE doc_id % 9 WHEN 0 THEN '  ' WHEN 1 THEN source || '.TXT' WHEN 2 THEN source || '.exe' WHEN 3 THEN 'known.pdf' WHEN 4 THEN source || '.docx' WHEN 5 THEN source || '.md' "
    "WHEN 6 THEN source WHEN 7 THEN '.txt' ELSE ' ' || source || '.b.md ' END AS filename, CASE doc_id % 9 WHEN 4 THEN 10485760 + n_chars WHEN 5 THEN n_chars % 2 ELSE n_chars END AS size_bytes FROM {docs}"
)


def frame(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql.replace("\\", "\\\\"))


def questions(spark: SparkSession) -> DataFrame:
    return frame(spark, QUESTION_SQL)


def turn_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a question."""
    return spark.sql(TURN_QUESTION_SQL.replace("''", "\\'"), turns=table(spark, sf_dir, "conversations"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(UPLOAD_SQL, docs=table(spark, sf_dir, "documents"))


def legal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEGAL_SPARK.replace("split(text, '\\n')", "split(text, '\\\\n')"), docs=table(spark, sf_dir, "documents"))


#: A document's chunk as retrieval sees it, twenty to a file: kind, article and path stand in by position, the language for the document's kind.
CHUNK_COLUMNS = """doc_id AS chunk_id, CAST(floor(doc_id / 20) + 3 AS BIGINT) AS document_id, CAST(doc_id AS INT) AS chunk_index, text AS content, CASE lang WHEN 'en' THEN 'mdr' WHEN 'fr' THEN 'ivdr' ELSE 'general' END AS doc_kind,
 CAST(1 + doc_id % 9 AS INT) AS page, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Article ' || CAST(doc_id % 12 AS STRING) END AS article,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 12 AS INT) END AS article_num, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 4 AS STRING) END AS paragraph,
 CASE WHEN doc_id % 5 = 0 THEN 'Annex ' || CASE WHEN doc_id % 2 = 0 THEN 'II' ELSE 'III' END ELSE 'Chapter I > Article ' || CAST(doc_id % 12 AS STRING) END AS section_path,
 CASE doc_id % 4 WHEN 0 THEN 'definition' WHEN 1 THEN 'obligation' WHEN 2 THEN 'list' ELSE 'body' END AS chunk_kind,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE upper(lang) END AS short_label, source || '.txt' AS filename"""


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks, the embedding null where there is none."""
    return plain_chunks(spark, sf_dir).join(vectors(spark, sf_dir), "chunk_id", "left")


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks, without embeddings."""
    return spark.sql(f"SELECT {CHUNK_COLUMNS} FROM {{docs}}", docs=table(spark, sf_dir, "documents"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS chunk_id", "embedding")


ALL_CHUNK_DUCK = f"SELECT c.*, e.embedding FROM (SELECT {CHUNK_COLUMNS} FROM documents) c LEFT JOIN embeddings e ON e.vec_id = c.chunk_id"
