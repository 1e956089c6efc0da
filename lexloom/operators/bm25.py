"""BM25 over a corpus, for whole batches of questions.

Postings are pruned to the questions' terms before the shuffle and kept; lengths and the number of documents go with them. Statistics belong to a scope (null for the whole corpus), so that a filtered corpus has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .lineage import kept, new_folder, small

K1, B = 1.5, 0.75


def tokenised(docs: DataFrame, id_column: str, text: str, *keep: str) -> DataFrame:
    """A null text has no tokens, as an empty one."""
    return docs.select(F.col(id_column).alias("doc_id"), *keep, tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def term_frequencies(tokenised_docs: DataFrame, *keep: str) -> DataFrame:
    return tokenised_docs.select("doc_id", *keep, F.explode("tokens").alias("term")).groupBy("doc_id", *keep, "term").agg(F.count("*").alias("tf"))


def document_frequencies(frequencies: DataFrame, *scope: str) -> DataFrame:
    return frequencies.groupBy(*scope, "term").agg(F.count("*").alias("df"))


def length_stats(tokenised_docs: DataFrame, *scope: str) -> DataFrame:
    """Documents and mean length, documents without tokens included; mean 0 for an empty corpus."""
    return tokenised_docs.groupBy(*scope).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avg_len"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n_tokens"))


def idf(n_docs: str = "n_docs", df: str = "df"):
    return F.log(1 + (F.col(n_docs) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def query_terms(questions: DataFrame, id_column: str, text: str, *keep: str) -> DataFrame:
    """(query_id, term, times): repeated terms count each time."""
    return questions.select(F.col(id_column).alias("query_id"), *keep, F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", *keep, "term").agg(F.count("*").alias("times"))


def scores(tokenised_docs: DataFrame, terms: DataFrame, *scope: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, scope, score) of documents that have a term of the question. Statistics are the scope's own.

    Texts are read once: tokens meet the questions' terms before any shuffle, each document's length goes with them under the null term, and the postings are kept. Weights and statistics come from
    these. Postings are then dealt by document and meet the questions' weighted terms there, so a document's scores are summed where its postings are, and pairs of question and document are not shuffled.
    """
    lengths = tokenised_docs.withColumn("len", F.size("tokens"))
    none = F.lit(None).cast("string").alias("term")
    exploded = lengths.select("doc_id", *scope, "len", F.explode(F.concat("tokens", F.array(none))).alias("term"))
    wanted = small(terms.select("term").distinct().union(terms.sparkSession.range(1).select(none)).withColumnRenamed("term", "wanted"))
    found = exploded.join(wanted, F.col("term").eqNullSafe(F.col("wanted")), "left_semi")
    counts = kept(found.groupBy("doc_id", *scope, "len", "term").agg(F.count("*").alias("tf")), new_folder(terms.sparkSession))
    postings = counts.filter("term is not null")
    stats = counts.filter("term is null").groupBy(*scope).agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("tf") * F.col("len")) / F.sum("tf")).alias("avg_len"))
    weights = document_frequencies(postings, *scope)
    weights = weights.join(stats, list(scope)) if scope else weights.crossJoin(F.broadcast(stats))  # one row
    asked = terms.join(weights, "term").select("query_id", *scope, "term", "avg_len", (F.col("times") * idf()).alias("weight"))
    matched = postings.repartition("doc_id").join(small(asked), [*scope, "term"])
    tf, size = F.col("tf"), F.col("len") / F.col("avg_len")
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size))
    return matched.groupBy("query_id", "doc_id", *scope).agg(F.sum(part).alias("score"))


def normalised(scored: DataFrame, *by: str, score: str = "score", out: str = "score") -> DataFrame:
    """Divided by the largest score of the group; zeros if that is not positive. The maximum is aggregated, then joined, so that a large
    group is not one task's."""
    top = scored.groupBy(*by).agg(F.max(score).alias("top")) if by else scored.agg(F.max(score).alias("top"))
    both = scored.join(top, list(by)) if by else scored.crossJoin(F.broadcast(top))
    return both.withColumn(out, F.when(F.col("top") > 0, F.col(score) / F.col("top")).otherwise(0.0)).drop("top")


def ranked(scored: DataFrame, k: int, by: list[str], *tie: str, score: str = "score") -> DataFrame:
    """The k best of each group by score, ties by ``tie``; adds ``rank`` from 1. Spark limits groups before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
