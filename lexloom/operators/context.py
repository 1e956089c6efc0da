"""Context of an answer: ranked hits within a size budget, then siblings of the first hits' articles in what is left of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import sibling_citation
from ..settings import DEFAULT
from .lineage import settled, small

ENTRY = ("query_id", "chunk_id", "citation", "content", "expanded", "ord", "used")


def primary(hits: DataFrame, budget: int = DEFAULT.max_context_chars, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hits in rank order up to the first that does not fit; the first always stays. Lengths are not negative, so the running sum never
    falls and the cut is a filter."""
    order = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = hits.withColumn("used", F.sum(F.length("content")).over(order))
    return own.filter((F.col("used") <= budget) | (F.col("rank") == 1))


def expanded(hits: DataFrame, chunks: DataFrame, budget: int = DEFAULT.max_context_chars, top_n: int = DEFAULT.expand_top_n) -> DataFrame:
    """Context entries of each question: its hits, then siblings (same document and article) of its first ``top_n`` hits.

    ``hits``: query_id, rank, chunk_id, document_id, article_num, citation, content. ``chunks``: chunk_id, document_id, chunk_index, article_num,
    article, paragraph, content, short_label, filename. Each hit's siblings run to the first that does not fit; the next hit's are
    tried with what is left.
    """
    first = primary(hits, budget)
    entries = first.select("query_id", "chunk_id", "citation", "content", F.lit(False).alias("expanded"), F.col("rank").cast("bigint").alias("ord"), "used")
    spent = first.groupBy("query_id").agg(F.max("used").alias("spent"))
    side = chunks.select(
        "document_id", "article_num", "chunk_index", F.col("chunk_id").alias("sibling_id"), F.col("content").alias("sibling_content"),
        sibling_citation(F.col("short_label"), F.col("filename"), F.col("article"), F.col("paragraph")).alias("sibling_citation"),
    )
    for rank in range(1, top_n + 1):
        near = hits.filter((F.col("rank") == rank) & F.col("article_num").isNotNull()).select("query_id", "document_id", "article_num")
        found = small(near).join(side, ["document_id", "article_num"])  # a row a question at most
        found = found.join(entries.select("query_id", F.col("chunk_id").alias("sibling_id")), ["query_id", "sibling_id"], "left_anti").join(spent, "query_id")
        order = Window.partitionBy("query_id").orderBy("chunk_index", "sibling_id").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("used", F.col("spent") + F.sum(F.length("sibling_content")).over(order)).filter(F.col("used") <= budget)
        added = found.select(
            "query_id", F.col("sibling_id").alias("chunk_id"), F.col("sibling_citation").alias("citation"), F.col("sibling_content").alias("content"),
            F.lit(True).alias("expanded"), (F.lit(1_000_000_000) * rank + F.col("chunk_index")).cast("bigint").alias("ord"), "used",
        )
        entries = settled(entries.unionByName(added))  # budget-bound rows that the next hit's siblings are held against
        spent = entries.groupBy("query_id").agg(F.max("used").alias("spent"))
    return entries


def rendered(entries: DataFrame, *by: str) -> DataFrame:
    """One text for each group: ``[citation]``, content, and a rule between entries."""
    item = F.concat(F.lit("["), "citation", F.lit("]\n"), "content")
    ordered = F.array_sort(F.collect_list(F.struct("ord", item.alias("item"))))
    return entries.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda e: e["item"]), "\n\n---\n\n").alias("context"))


def section(label: Column, body: Column) -> Column:
    return F.concat(F.lit("=== "), label, F.lit(" ===\n"), body)
