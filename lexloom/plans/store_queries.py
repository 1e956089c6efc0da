"""Queries on the store's transformations, files, history, events and streaming ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..operators import answer, changelog, store
from ..operators.lineage import in_order, new_folder, shared_root
from ..streaming import events as ev
from ..streaming import landing, live
from . import fixtures
from .registry import ORACLES, query, table

#: Documents and events as the store's rows: positions stand in for status, kind, error and times.
DOCUMENT_COLUMNS = """doc_id AS id, source || '-' || CAST(doc_id % 40 AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END AS filename, 'f' || CAST(doc_id AS STRING) AS stored_name,
 CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END AS file_type, n_chars AS size_bytes, CASE doc_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'indexing' WHEN 2 THEN 'failed' ELSE 'ready' END AS status,
 CASE lang WHEN 'en' THEN 'mdr' WHEN 'fr' THEN 'ivdr' ELSE 'general' END AS doc_kind, upper(lang) AS short_label, CAST(doc_id % 9 AS INT) AS chunk_count, CAST(1 AS INT) AS page_count,
 CASE WHEN doc_id % 7 = 2 THEN 'bad file' END AS error, doc_id % 13 AS created"""
DOCS_DUCK = f"WITH d AS (SELECT {DOCUMENT_COLUMNS} FROM documents)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT {DOCUMENT_COLUMNS} FROM {{docs}}", docs=table(spark, sf_dir, "documents"))
    return own.withColumn("created_at", F.timestamp_seconds("created")).withColumn("indexed_at", F.lit(None).cast("timestamp"))


@query(f"{DOCS_DUCK} SELECT id, filename, status, CAST(row_number() OVER (ORDER BY created DESC, id DESC) AS BIGINT) AS place FROM d")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place, newest first."""
    return in_order(documents(spark, sf_dir).select("id", "filename", "status", "created_at"), F.desc("created_at"), F.desc("id")).drop("created_at")


@query(f"{DOCS_DUCK} SELECT id, filename, status FROM d WHERE id = 17")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter("id = 17").select("id", "filename", "status")


@query(f"{DOCS_DUCK} SELECT id, filename, file_type, size_bytes, status, doc_kind, short_label, chunk_count, page_count, error FROM d")
def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.served(documents(spark, sf_dir)).drop("created_at", "indexed_at")


@query(f"{DOCS_DUCK}, c AS (SELECT {fixtures.CHUNK_COLUMNS} FROM documents) SELECT c.chunk_id, d.filename, d.short_label, d.doc_kind FROM c JOIN d ON d.id = c.document_id WHERE status = 'ready'")
def ready_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all ready documents, with an embedding or without."""
    chunks = fixtures.plain_chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "document_id", "content")
    return store.ready_chunks(chunks, documents(spark, sf_dir)).select("chunk_id", "filename", "short_label", "doc_kind")


@query(f"WITH c AS ({fixtures.ALL_CHUNK_DUCK}) SELECT chunk_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM c WHERE document_id = 7 AND article_num = 9")
def sibling_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.siblings(fixtures.plain_chunks(spark, sf_dir), 7, 9).select("chunk_id", F.col("chunk_index").cast("bigint").alias("chunk_index"))


@query(f"{DOCS_DUCK} SELECT status, count(*) AS n FROM d GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.status_counts(documents(spark, sf_dir))


@query(f"{DOCS_DUCK} SELECT count(*) AS documents, count(*) FILTER (WHERE status = 'ready') AS ready FROM d")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.health(documents(spark, sf_dir)).select("documents", "ready")


@query(f"{DOCS_DUCK} SELECT id, CASE WHEN status IN ('pending', 'indexing') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('pending', 'indexing') THEN 'interrupted before it was indexed' ELSE error END AS error FROM d")
def stale_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.reset_stale(documents(spark, sf_dir)).select("id", "status", "error")


@query(f"{DOCS_DUCK} SELECT id, CASE WHEN id % 5 = 0 THEN 'ready' WHEN id % 5 = 1 THEN 'failed' WHEN id % 5 = 2 THEN 'indexing' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 4 ELSE chunk_count END AS chunk_count, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN repeat('x', 1000) ELSE error END AS error FROM d")
def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three changes of status through the log: each appends the documents that it changes."""
    log = changelog.Log(spark, f"{new_folder(spark)}/documents", schema.DOCUMENTS, "id")
    log.replace(lambda _seen: documents(spark, sf_dir))
    every = F.lit(True)
    log.commit(lambda docs, _top: store.mark_ready(docs.filter("id % 5 = 0"), every, F.lit(4), F.lit(2), F.lit("regulation"), F.lit("X")))
    log.commit(lambda docs, _top: store.mark_failed(docs.filter("id % 5 = 1"), every, "x" * 3000))
    log.commit(lambda docs, _top: store.mark_indexing(docs.filter("id % 5 = 2"), every))
    return log.read().select("id", "status", "chunk_count", "error")


@query(f"{DOCS_DUCK}, c AS ({fixtures.ALL_CHUNK_DUCK}) SELECT 'chunks' AS kind, count(*) AS n FROM c WHERE document_id NOT IN (1, 2, 3) UNION ALL SELECT 'documents', count(*) FROM d WHERE id NOT IN (1, 2, 3)")
def delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.range(1, 4)
    chunks = store.without(fixtures.plain_chunks(spark, sf_dir), gone, "document_id").agg(F.lit("chunks").alias("kind"), F.count("*").alias("n"))
    return chunks.unionByName(store.without(documents(spark, sf_dir), gone, "id").agg(F.lit("documents").alias("kind"), F.count("*").alias("n")))


NAME_SQL = "regexp_replace(filename, '^\\s+|\\s+$', '', 'g')"


@query(
    f"WITH u AS ({fixtures.UPLOAD_SQL.replace('{docs}', 'documents')}), s AS (SELECT *, {NAME_SQL} AS name FROM u) SELECT upload_id, CAST(CASE WHEN name = '' THEN 400 WHEN NOT regexp_matches(lower(name), '[^./]\\.(txt|md|pdf|docx)$') THEN 415 WHEN name = 'known.pdf' THEN 409 WHEN size_bytes > 10485760 THEN 413 WHEN size_bytes = 0 THEN 400 END AS INTEGER) AS code FROM s"
)
def upload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an upload."""
    own = fixtures.uploads(spark, sf_dir)
    return own.select("upload_id", store.upload_error(F.col("filename"), F.col("size_bytes"), F.col("filename") == "known.pdf", F.lit(3)).alias("code"))


# History: turns of conversations as answered questions

HISTORY_COLUMNS = "conv_id * 100 + turn AS id, 'Q ' || text AS question, text AS answer, CASE turn % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'synthesis' ELSE 'refused' END AS answer_path, CAST(turn % 10 AS DOUBLE) / 10 AS confidence, conv_id * 7 + turn AS elapsed_ms, turn AS sec"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT {HISTORY_COLUMNS} FROM {{t}}", t=table(spark, sf_dir, "conversations"))
    source = F.struct(F.concat(F.lit("MDR, Article "), F.col("sec").cast("string")).alias("citation"), F.lit(0.5).alias("score"), F.col("id").alias("chunk_id"), F.lit("MDR").alias("short_label"), F.col("answer").alias("content"))
    none = F.array().cast("array<struct<citation:string,score:double,chunk_id:bigint,short_label:string,content:string>>")
    return own.withColumn("sources", F.when(F.col("sec") % 2 == 0, F.array(source)).otherwise(none)).withColumn("created_at", F.timestamp_seconds("sec"))


HISTORY_DUCK = f"WITH h AS (SELECT {HISTORY_COLUMNS} FROM conversations)"


@query(f"{HISTORY_DUCK} SELECT id, question, confidence FROM h ORDER BY id DESC LIMIT 50")
def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest rows, as the history shows them."""
    return store.recent(history(spark, sf_dir)).select("id", "question", "confidence")


@query(f"{HISTORY_DUCK} SELECT id, 'MDR, Article ' || CAST(sec AS VARCHAR) || '|0.5|' || CAST(id AS VARCHAR) || '|MDR' AS source FROM h WHERE sec % 2 = 0")
def history_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = history(spark, sf_dir).select("id", F.explode(store.slim(F.col("sources"))).alias("s"))
    return own.select("id", F.concat_ws("|", "s.citation", F.col("s.score").cast("string"), F.col("s.chunk_id").cast("string"), "s.short_label").alias("source"))


@query(
    f"{HISTORY_DUCK}, r AS (SELECT * FROM h ORDER BY id DESC LIMIT 50) SELECT '# Session export' || chr(10) || chr(10) || string_agg('## ' || question || chr(10) || chr(10) || answer || chr(10) || chr(10) || '*Confidence: ' || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '% · path: ' || answer_path || ' · ' || CAST(elapsed_ms AS VARCHAR) || ' ms · ' || strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%S') || '*' "
    "|| CASE WHEN sec % 2 = 0 THEN chr(10) || chr(10) || '**Sources**' || chr(10) || '- MDR, Article ' || CAST(sec AS VARCHAR) || ' (score 0.5)' ELSE '' END || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY id) AS markdown FROM r"
)
def history_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.export_markdown(history(spark, sf_dir))


# Events and streaming


@query(
    f"{HISTORY_DUCK}, e AS (SELECT id, unnest(CASE WHEN answer_path = 'synthesis' THEN ['status', 'status', 'sources', 'status', 'token', 'done'] ELSE ['status', 'status', 'sources', 'token', 'done'] END) AS type, unnest(range(CASE WHEN answer_path = 'synthesis' THEN 6 ELSE 5 END)) AS seq FROM h) SELECT id AS query_id, CAST(seq AS BIGINT) AS seq, type FROM e"
)
def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = history(spark, sf_dir).select(F.col("id").alias("query_id"), F.lit("general").alias("question_type"), F.lit("ask").alias("mode"), "answer", "answer_path", "confidence")
    return ev.events(own).select("query_id", F.col("seq").cast("bigint").alias("seq"), "type")


@query(f"{HISTORY_DUCK}, t AS (SELECT id, regexp_extract_all(answer, '\\s*\\S+\\s*') AS f FROM h WHERE answer_path = 'synthesis') SELECT id AS query_id, CAST(unnest(range(4, 4 + len(f))) AS BIGINT) AS seq, unnest(f) AS text FROM t")
def sse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token events of streamed answers, whose fragments are their words."""
    own = history(spark, sf_dir).select(F.col("id").alias("query_id"), F.lit("general").alias("question_type"), F.lit("ask").alias("mode"), "answer", "answer_path", "confidence", "sources")
    own = own.filter("answer_path = 'synthesis'").withColumn("fragments", F.regexp_extract_all("answer", F.lit(r"\s*\S+\s*"), 0))
    shown = ev.events(own).filter("type = 'token'")
    return shown.select("query_id", F.col("seq").cast("bigint").alias("seq"), F.get_json_object("payload", "$.text").alias("text"))


@query(f"{HISTORY_DUCK} SELECT count(*) AS n, count(*) FILTER (WHERE answer_path <> 'refused') AS n_passed, round(avg(elapsed_ms / 1000.0::DOUBLE), 6) AS avg_seconds, max(elapsed_ms / 1000.0::DOUBLE) AS max_seconds FROM h")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = answer.evaluation(history(spark, sf_dir).select((F.col("answer_path") != "refused").alias("passed"), "elapsed_ms"))
    return own.withColumn("avg_seconds", F.round("avg_seconds", 6))


@query(f"{HISTORY_DUCK} SELECT id AS query_id, CAST(seq AS BIGINT) AS seq, type, CASE WHEN type = 'token' THEN answer END AS text FROM h, (VALUES (0, 'status'), (2, 'token')) AS t(seq, type)")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a status, a broken and a token event, and a last one cut short: two are read."""
    return ev.parsed(streams(spark, sf_dir)).select("query_id", F.col("seq").cast("bigint").alias("seq"), "event.type", "event.text")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda **v: ev.framed(F.to_json(F.struct(*(x.alias(k) for k, x in v.items()))))
    stream = F.concat(frame(type=F.lit("status"), stage=F.lit("planning")), F.lit("data: {broken\n\n"), frame(type=F.lit("token"), text=F.col("answer")), F.lit('data: {"type":"do'))
    return history(spark, sf_dir).select(F.col("id").alias("query_id"), stream.alias("stream"))


def landed(rows: DataFrame, folder: str, schema: str) -> DataFrame:
    """``rows`` as a stream of three batches, each of a file for every core, dealt without regard to their order."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(3 * tasks).write.parquet(f"{folder}/in")
    return rows.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", tasks).parquet(f"{folder}/in")


@query(ORACLES["sse_parse"])
def sse_stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``sse_parse`` from a running stream whose pieces are 61 bytes each, whatever they cut, and come in any order."""
    folder = new_folder(spark)
    whole = streams(spark, sf_dir).select(F.col("query_id").alias("stream"), F.encode("stream", "UTF-8").alias("data"))
    at = F.explode(F.expr("sequence(0L, cast(octet_length(data) as bigint) - 1, 61L)"))
    pieces = whole.select("stream", at.alias("at"), "data").select("stream", "at", F.expr("substring(data, cast(at + 1 as int), 61)").alias("data"))
    found = live.run(spark, live.frames(landed(pieces, folder, "stream bigint, at bigint, data binary")), folder)
    return found.select(F.col("stream").alias("query_id"), "seq", "event.type", "event.text")


@query(
    f"{HISTORY_DUCK}, t AS (SELECT id, answer, regexp_extract_all(answer, '\\s*\\S+\\s*') AS f FROM h WHERE answer_path = 'synthesis') "
    "SELECT id AS query_id, CAST(unnest(range(len(f) + 1)) AS BIGINT) AS seq, unnest(list_append(list_transform(f, lambda x: 'token'), 'done')) AS type, unnest(list_append(f, array_to_string(f, ''))) AS text FROM t WHERE len(f) > 0"
)
def sse_stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a model speaks word by word, as a running stream shows them: tokens in their order as they come, then the whole."""
    folder = new_folder(spark)
    words = history(spark, sf_dir).filter("answer_path = 'synthesis'").select(F.col("id").alias("query_id"), F.regexp_extract_all("answer", F.lit(r"\s*\S+\s*"), 0).alias("words"))
    each = words.select("query_id", F.size("words").alias("many"), F.posexplode("words").alias("n", "fragment"))
    rows = each.select("query_id", F.col("n").cast("bigint").alias("n"), "fragment", (F.col("n") + 1 == F.col("many")).alias("last"))
    found = live.run(spark, live.spoken(landed(rows, folder, "query_id bigint, n bigint, fragment string, last boolean")), folder)
    return found.drop("batch")


@query(f"WITH d AS (SELECT n_chars AS size_bytes, CAST(doc_id AS DOUBLE) % 11 / 10 AS confidence, doc_id FROM documents) SELECT doc_id, CASE WHEN size_bytes < 1024 THEN CAST(size_bytes AS VARCHAR) || ' B' ELSE CAST(CAST(round(size_bytes / 1024) AS BIGINT) AS VARCHAR) || ' KB' END AS size, CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.35 THEN 'medium' ELSE 'low' END AS trust FROM d")
def labels_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size_bytes"), (F.col("doc_id").cast("double") % 11 / 10).alias("confidence"))
    return own.select("doc_id", text.size_label(F.col("size_bytes")).alias("size"), text.confidence_label(F.col("confidence")).alias("trust"))


@query()
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page lands as a text file of its structure-bearing lines; the stream indexes them. Rows: each document's status and chunks."""
    import uuid

    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    lines = fixtures.legal_lines(spark, sf_dir).withColumn("part", F.col("document_id"))
    body = lines.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    tasks = max(8, spark.sparkContext.defaultParallelism)
    named = body.repartition(tasks).select(F.format_string("part-%05d-%d.txt", F.spark_partition_id(), "part").alias("name"), "value")
    landed_in = landing.land(named, f"{root}/text")
    own = store.Store(spark, f"{root}/store")
    running = landing.watch(spark, landed_in, own, f"{root}/checkpoint")
    running.awaitTermination()
    chunks = own.chunks().groupBy("document_id").agg(F.count("*").alias("chunks"))
    return own.documents().join(chunks, F.col("id") == F.col("document_id"), "left").select("id", "status", "doc_kind", "page_count", F.coalesce("chunks", F.lit(0)).alias("chunks"))
