"""What a caller can ask of the engine, over one store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import models
from .operators import answer, store
from .functions.text import NO_ANSWER
from .operators.ingest import ingest
from .operators.lineage import settled
from .settings import DEFAULT, Settings
from .sources.readers import pages_of, suffix
from .streaming.events import events


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: models.Embedder | None = None, chat: models.ChatModel | None = None, settings: Settings = DEFAULT) -> None:
        self.spark, self.settings = spark, settings
        self.store = store.Store(spark, root)
        self.embedder, self.chat = embedder or models.HashEmbedder(settings.embed_width), chat or models.ScriptedChat(NO_ANSWER)

    def health(self, probed: bool = False) -> DataFrame:
        """Counts and models; with ``probed`` both models are tried, and ``models`` says how each did."""
        own = store.health(self.store.documents(), self.settings)
        if not probed:
            return own
        state = models.probe(self.spark, self.embedder, self.chat)
        return own.withColumn("models", F.struct(*(F.lit(v).alias(k) for k, v in state.items())))

    def list_documents(self) -> DataFrame:
        return store.served(store.listed(self.store.documents()))

    def document(self, number: int) -> DataFrame:
        return store.served(self.store.documents().filter(F.col("id") == number))

    def upload(self, path: str) -> DataFrame:
        """Index the files below ``path`` that no rule rejects; gives (filename, code, id): the rule's code, or the new document's id.

        Empty files are not listed (Spark skips them); of files with one name the first path counts. Files beyond the limit of documents, in path
        order, and later files of a name get 409 like any that exists. Accepted files, as many as the limit at most, are kept in the store under names of their own.
        """
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        names = self.store.documents().select("filename").distinct().withColumn("known", F.lit(True))
        listed = rows.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), suffix().alias("file_type"), F.col("length").alias("size_bytes")).join(names, "filename", "left")
        active = self.store.documents().count()
        checked = listed.withColumn("code", store.upload_error(F.col("filename"), F.col("size_bytes"), F.coalesce("known", F.lit(False)), F.lit(active), self.settings))
        good = checked.filter("code is null").groupBy("filename").agg(F.min_by(F.struct("path", "file_type", "size_bytes"), "path").alias("f")).orderBy("f.path").limit(max(0, self.settings.max_documents - active))
        fresh = good.select("filename", "f.path", "f.file_type", "f.size_bytes", store.stored_name(F.col("filename")).alias("stored_name")).collect()  # max_documents rows at most
        kept = self.spark.createDataFrame(fresh, "filename string, path string, file_type string, size_bytes bigint, stored_name string")
        if fresh:
            places = [self.store.keep_file(r.path, r.stored_name) for r in fresh]
            ids = self.store.create(kept.drop("path"))
            named = self.store.documents().select(F.col("id").alias("document_id"), "stored_name")
            found = pages_of(self.spark.read.format("binaryFile").load(places).select("path", "content"))
            found = found.withColumn("stored_name", F.regexp_extract("path", "([^/]+)$", 1)).join(named, "stored_name")
            ingest(self.store, found.select("document_id", "page", "text"), ids, self.embedder, self.settings)
        indexed = kept.select("path", "stored_name").join(self.store.documents().select("stored_name", "id"), "stored_name").select("path", "id")
        out = checked.select("path", "filename", "code").join(indexed, "path", "left")
        return out.select("filename", F.when(F.col("code").isNull() & F.col("id").isNull(), 409).otherwise(F.col("code")).alias("code"), "id")

    def delete_document(self, number: int) -> None:
        self.store.delete([number])

    def ask(self, questions: DataFrame, document_ids: list[int] | None = None, record: bool = True) -> DataFrame:
        """Answers to ``questions`` (query_id, question); ``document_ids`` narrows what asks see, an empty list doesn't.

        Comparisons look at all documents, whatever is asked for. The batch is answered once; what is recorded and what is given back are the same
        rows, each with the time that the batch took."""
        began = time.monotonic()
        ready = store.ready_chunks(self.store.chunks(), self.store.documents())
        chosen = store.ready_chunks(self.store.chunks(), self.store.documents(), document_ids)
        out = settled(answer.answer(questions, chosen, self.embedder, self.chat, self.settings, all_chunks=ready))
        out = out.withColumn("elapsed_ms", F.lit(int(1000 * (time.monotonic() - began))).cast("bigint"))
        if record:
            self.store.record(out)
        return out

    def ask_events(self, questions: DataFrame, document_ids: list[int] | None = None) -> DataFrame:
        return events(self.ask(questions, document_ids))

    def history(self, limit: int | None = None) -> DataFrame:
        return store.recent(self.store.history(), limit or self.settings.history_limit)

    def clear_history(self) -> None:
        self.store.clear_history()

    def export_markdown(self, limit: int | None = None) -> DataFrame:
        return store.export_markdown(self.store.history(), limit or self.settings.history_limit)
