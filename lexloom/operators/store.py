"""Tables of documents, chunks, history and leases.

Documents, history and leases are logs of commits (``changelog``): a change appends the rows it changes, and writers at the same time all get through. Chunks lie in a
folder for each batch that was indexed, not for each document, and a log says which batch holds a document's current ones: files and folders don't grow with the documents of a
batch, and readers see all of a batch or nothing. A delete writes the rest of its documents' batches anew.

Who indexes a document holds a lease on it, with an end. What was under way when its worker stopped is found by leases that have ended; work that is alive is left alone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..settings import DEFAULT, EXTENSIONS, Settings
from .changelog import GONE, Log
from .lineage import in_order, settled

PENDING, INDEXING, READY, FAILED = "pending", "indexing", "ready", "failed"
ERROR_CHARS = 1000


# Transformations, on any DataFrame of the right columns


def listed(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), F.desc("id"))


def ready_chunks(chunks: DataFrame, documents: DataFrame, document_ids: list[int] | None = None) -> DataFrame:
    """Chunks of ready documents with the documents' columns; an empty list filters nothing."""
    own = documents.filter(F.col("status") == READY)
    own = own.filter(F.col("id").isin(document_ids)) if document_ids else own
    side = own.select(F.col("id").alias("document_id"), "filename", "short_label", "doc_kind")
    return chunks.withColumnRenamed("id", "chunk_id").join(side, "document_id")


def siblings(chunks: DataFrame, document_id: int, article_num: int | None) -> DataFrame:
    """Chunks of one article in order, whatever the document's status; none without an article."""
    return chunks.filter((F.col("document_id") == document_id) & (F.col("article_num") == F.lit(article_num))).orderBy("chunk_index")


def with_new_ids(rows: DataFrame, largest: int, *order: str) -> DataFrame:
    """Ids from ``largest`` + 1 in a stated order."""
    return in_order(rows, *order, into="id").withColumn("id", (F.col("id") + largest).cast("bigint"))


def set_status(documents: DataFrame, ids: Column, status: str, **values: Column) -> DataFrame:
    """``status`` and further columns where ``ids`` holds."""
    changes = {"status": F.lit(status), **values}
    return documents.withColumns({c: F.when(ids, v).otherwise(F.col(c)).cast(documents.schema[c].dataType) for c, v in changes.items()})


def mark_indexing(documents: DataFrame, which: Column) -> DataFrame:
    return set_status(documents, which, INDEXING)


def mark_ready(documents: DataFrame, which: Column, chunk_count: Column, page_count: Column, kind: Column, label: Column) -> DataFrame:
    return set_status(documents, which, READY, chunk_count=chunk_count, page_count=page_count, doc_kind=kind, short_label=label, indexed_at=F.current_timestamp(), error=F.lit(None))


def mark_failed(documents: DataFrame, which: Column, error: str) -> DataFrame:
    return set_status(documents, which, FAILED, error=F.substring(F.lit(error), 1, ERROR_CHARS))


def reset_stale(documents: DataFrame, error: str = "interrupted before it was indexed") -> DataFrame:
    """What was pending or being indexed when the engine stopped has failed."""
    return mark_failed(documents, F.col("status").isin(PENDING, INDEXING), error)


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among ``ids`` (column id)."""
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_anti")


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count("*").alias("n"))


def health(documents: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == READY).alias("ready"), F.lit(settings.max_documents).alias("max_documents"), F.lit(settings.embed_width).alias("embedding_width"), F.lit(settings.chat_model).alias("chat_model"), F.lit(settings.embedding_model).alias("embedding_model"))


def served(documents: DataFrame) -> DataFrame:
    """The columns that callers see."""
    return documents.select("id", "filename", "file_type", "size_bytes", "status", "doc_kind", "short_label", "chunk_count", "page_count", "error", "created_at", "indexed_at")


def stored_name(filename: Column) -> Column:
    """A name of its own for a landed file: random, with the file's suffix."""
    return F.concat(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), F.lower(F.regexp_extract(filename, r"(\.[^./]*)$", 1)))


def upload_error(filename: Column, size: Column, existing: Column, active: Column, settings: Settings = DEFAULT) -> Column:
    """The first rule an upload breaks, as a status code; null for none."""
    name = F.regexp_replace(filename, r"(?U)^\s+|\s+$", "")
    suffix = F.lower(F.regexp_extract(name, r"(?<=[^./])(\.[^./]*)$", 1))
    return (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, 400)
        .when(~suffix.isin(*EXTENSIONS), 415)
        .when(active >= settings.max_documents, 409)
        .when(existing, 409)
        .when(size > settings.max_file_mb * 1024 * 1024, 413)
        .when(size == 0, 400)
    )


def recent(history: DataFrame, limit: int = DEFAULT.history_limit) -> DataFrame:
    return history.orderBy(F.desc("id")).limit(limit)


def slim(sources: Column) -> Column:
    """Only what the history keeps of an answer's sources."""
    return F.transform(sources, lambda s: F.struct(s["citation"].alias("citation"), s["score"].alias("score"), s["chunk_id"].alias("chunk_id"), s["short_label"].alias("short_label")))


def entry_markdown(row: tuple[str, ...] = ("question", "answer", "confidence", "answer_path", "elapsed_ms", "created_at", "sources")) -> Column:
    """One history row as Markdown."""
    question, answer, confidence, path, elapsed, created, sources = (F.col(c) for c in row)
    meta = F.concat(F.lit("*Confidence: "), F.round(confidence * 100).cast("int").cast("string"), F.lit("% · path: "), path, F.lit(" · "), elapsed.cast("string"), F.lit(" ms · "), F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("*"))
    listed_ = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("- "), s["citation"], F.lit(" (score "), s["score"].cast("string"), F.lit(")"))), "\n")
    cited = F.when(F.size(sources) > 0, F.concat(F.lit("\n\n**Sources**\n"), listed_)).otherwise(F.lit(""))
    return F.concat(F.lit("## "), question, F.lit("\n\n"), answer, F.lit("\n\n"), meta, cited, F.lit("\n\n---\n"))


def export_markdown(history: DataFrame, limit: int = DEFAULT.history_limit, title: str = "Session export") -> DataFrame:
    """The last ``limit`` rows, oldest first, as one Markdown text (column ``markdown``)."""
    own = recent(history, limit).select("id", entry_markdown().alias("entry"))
    parts = F.array_sort(F.collect_list(F.struct("id", "entry")))
    return own.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(parts, lambda p: p["entry"]), "\n")).alias("markdown"))


class Store:
    """The tables below one folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.logs = {
            "documents": Log(spark, f"{self.root}/documents", schema.DOCUMENTS, "id"),
            "history": Log(spark, f"{self.root}/history", schema.HISTORY),
            "leases": Log(spark, f"{self.root}/leases", schema.LEASES, "id"),
            "chunk_batches": Log(spark, f"{self.root}/chunk_batches", schema.CHUNK_BATCHES, "id"),
        }

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def documents(self) -> DataFrame:
        return self.logs["documents"].read()

    def history(self) -> DataFrame:
        return self.logs["history"].read()

    def chunks(self) -> DataFrame:
        if not self.fs.exists(self._path("chunks")):
            return self.spark.createDataFrame([], schema.CHUNKS)
        return self._current().select(*StructType.fromDDL(schema.CHUNKS).names)

    def _current(self) -> DataFrame:
        """Chunks with their ``batch``, without those that a later batch of their document has replaced."""
        rows = self.spark.read.schema(f"{schema.CHUNKS}, batch string").parquet(f"{self.root}/chunks")
        return rows.join(self.logs["chunk_batches"].read().withColumnRenamed("id", "document_id"), ["document_id", "batch"], "left_semi")

    def create(self, rows: DataFrame) -> range:
        """Add pending documents (filename, stored_name, file_type, size_bytes); give their ids, which follow each other."""
        log = self.logs["documents"]
        values = {"status": F.lit(PENDING), "doc_kind": F.lit("general"), "chunk_count": F.lit(0), "page_count": F.lit(0), "created_at": F.current_timestamp()}

        def added(_seen: DataFrame, top: int) -> DataFrame:
            new = with_new_ids(rows, top, "filename", "stored_name")
            return new.withColumns({f.name: values.get(f.name, F.lit(None)).cast(f.dataType) for f in log.schema if f.name not in new.columns})

        top, count = log.commit(added, numbered="id")
        return range(top + 1, top + 1 + count)

    def update(self, change: Callable[[DataFrame], DataFrame], ids: DataFrame | None = None) -> None:
        """Append what ``change`` makes of the documents, or of those in ``ids`` (column id). Rows that it leaves as they were are not written."""

        def changed(seen: DataFrame, _top: int) -> DataFrame:
            own = seen if ids is None else seen.join(ids.select("id").distinct(), "id", "left_semi")
            new = change(own)
            old = own.select("id", F.struct(*own.columns).alias("__old"))
            now = F.struct(*(F.col(c).cast(own.schema[c].dataType) for c in own.columns))
            return new.join(old, "id").filter(~now.eqNullSafe(F.col("__old"))).select(own.columns)

        self.logs["documents"].commit(changed)

    def claim(self, ids: DataFrame, owner: str, seconds: float = DEFAULT.lease_seconds) -> DataFrame:
        """Take leases on ``ids`` (column id) for ``owner``, or lengthen its own; gives those that it has now (id). Of two that ask at once one gets each."""
        log = self.logs["leases"]
        now = time.time()

        def taken(seen: DataFrame, _top: int) -> DataFrame:
            held = seen.filter((F.col("until") > now) & (F.col("owner") != owner))
            return ids.select("id").distinct().join(held, "id", "left_anti").withColumns({"owner": F.lit(owner), "until": F.lit(now + seconds)})

        log.commit(taken)
        return log.read().filter((F.col("owner") == owner) & (F.col("until") > now)).join(ids.select("id").distinct(), "id", "left_semi").select("id")

    def release(self, owner: str) -> None:
        self.logs["leases"].commit(lambda seen, _top: seen.filter(F.col("owner") == owner).withColumn(GONE, F.lit(True)))

    def live(self, now: float | None = None) -> DataFrame:
        """(id) of the documents with a lease that has not ended."""
        return self.logs["leases"].read().filter(F.col("until") > (time.time() if now is None else now)).select("id")

    def recover(self, now: float | None = None) -> None:
        """What was pending or being indexed has failed, unless a lease on it is alive."""
        alive = settled(self.live(now))
        self.update(lambda docs: reset_stale(docs.join(alive, "id", "left_anti")))

    def insert_chunks(self, chunks: DataFrame) -> None:
        """Write chunks that have ids, in place of those that their documents had; a null kind is ``body``."""
        batch, path = self._new_batch()
        chunks.withColumn("chunk_kind", F.coalesce("chunk_kind", F.lit("body"))).write.parquet(path)
        ids = self.spark.read.schema("document_id bigint").parquet(path).select(F.col("document_id").alias("id")).distinct()
        self.logs["chunk_batches"].commit(lambda _seen, _top: ids.withColumn("batch", F.lit(batch)))

    def _new_batch(self) -> tuple[str, str]:
        batch = f"b{uuid.uuid4().hex}"
        return batch, f"{self.root}/chunks/batch={batch}"

    def _delete_chunks(self, gone: DataFrame) -> None:
        """The batches that hold chunks of ``gone`` (id) are written anew without them. Documents that another worker has indexed meanwhile keep what it wrote."""
        log, gone = self.logs["chunk_batches"], F.broadcast(gone)
        held = [r.batch for r in log.read().join(gone, "id", "left_semi").select("batch").distinct().collect()]  # one at most for each of a call's ids
        if not held:
            return
        batch, path = self._new_batch()
        rest = self._current().filter(F.col("batch").isin(held)).join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
        rest.select(*StructType.fromDDL(schema.CHUNKS).names).write.parquet(path)
        marked = gone.withColumn(GONE, F.lit(True))
        log.commit(lambda seen, _top: seen.filter(F.col("batch").isin(held)).withColumn("batch", F.lit(batch)).join(marked, "id", "left").withColumn(GONE, F.coalesce(GONE, F.lit(False))))
        for old in held:
            self.fs.delete(self._path(f"chunks/batch={old}"), True)

    def delete(self, ids: list[int]) -> None:
        """Chunks first, then kept files, then the documents; ``ids`` are those of one call, not of a table."""
        gone = self.spark.createDataFrame([(n,) for n in ids], "id bigint")
        self._delete_chunks(gone)
        for row in self.documents().join(F.broadcast(gone), "id", "left_semi").select("stored_name").collect():
            if row.stored_name and "/" not in row.stored_name:
                self.fs.delete(self._path(f"files/{row.stored_name}"), False)
        self.logs["documents"].commit(lambda seen, _top: seen.join(F.broadcast(gone), "id", "left_semi").withColumn(GONE, F.lit(True)))

    def keep_file(self, path: str, name: str) -> str:
        """Copy a file into the store under its stored name; gives the copy's path."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        source, target = hadoop.Path(path), self._path(f"files/{name}")
        conf = self.spark._jsc.hadoopConfiguration()
        hadoop.FileUtil.copy(source.getFileSystem(conf), source, self.fs, target, False, conf)
        return f"{self.root}/files/{name}"

    def record(self, rows: DataFrame) -> None:
        """Append answers to the history with slim sources; rejected questions have none."""
        rows = rows.filter(F.col("answer_path") != "rejected")
        made = rows.withColumn("sources", slim(F.col("sources"))).withColumn("created_at", F.current_timestamp())
        self.logs["history"].commit(lambda _seen, top: with_new_ids(made, top, "query_id"), numbered="id")

    def clear_history(self) -> None:
        self.logs["history"].replace(lambda seen: seen.limit(0))
