"""A block-max inverted index: postings kept by term in blocks with upper bounds, and exact top-k that reads only the blocks it needs.

Documents are range-sorted by (scope, id) and dealt into segments of ``SEGMENT`` neighbours, and ``SPAN`` segments are a span. A block holds a term's postings in a
segment, with the largest frequency and the least document length in it; no score in the block exceeds what these two give, whatever the statistics are. The
same is kept for each term and span. The null term's postings are all documents: lengths and counts come from it.

A batch of questions is answered from the bounds downwards. The spans of the highest bounds give seeds, whose segments of the highest bounds are scored; their k-th
best score is a threshold that no document below can pass. Spans that reach it are opened, segments that reach it are scored, and nothing else is read:
the bounds are columns of their own, and postings of other segments never leave the scan. The result is that of scoring all documents.

Defined cases: a document without tokens counts for the statistics and has no score; ties go to the lesser id; a threshold needs k scored documents, before that
nothing is left out; a null scope is the scope of the empty name; an empty corpus or a question without known terms gives no rows; texts count whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .bm25 import K1, B, idf, ranked
from .lineage import discarded, kept, new_folder, small

SEGMENT, SPAN, SEEDS = 128, 64, 4
#: Characters of text that a task of a build has, and pairs of a question and a document that a task of a search may have: the number of tasks follows the
#: input, a task's memory does not.
PART_CHARS, PART_PAIRS = 8 << 20, 1 << 20


@dataclass(frozen=True)
class Index:
    """The tables of an index below one folder; any session that reads the folder can ask it."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def blocks(self) -> DataFrame:
        """term, scope, segment, span, n, max_tf, min_len, postings (doc_id, tf, len)."""
        return self.table("blocks")

    @property
    def spans(self) -> DataFrame:
        """term, scope, span, max_tf, min_len."""
        return self.table("spans")

    @property
    def frequencies(self) -> DataFrame:
        """term, scope, df."""
        return self.table("frequencies")

    @property
    def scopes(self) -> DataFrame:
        """scope, n_docs, n_tokens."""
        return self.table("scopes")

    def drop(self) -> None:
        discarded(self.spark, self.folder)


def parts_of(spark: SparkSession, size: int, most: int) -> int:
    """Partitions of ``most`` at most, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // most))


def pair_parts(index: Index, terms: DataFrame) -> int:
    """Partitions for pairs of the questions of ``terms`` (query_id) and the index's documents, were all of them to meet."""
    asked = terms.select("query_id").distinct().count()
    return parts_of(index.spark, asked * (index.scopes.agg(F.sum("n_docs")).first()[0] or 0), PART_PAIRS)


def build(docs: DataFrame, id_column: str, text: str, scope: str | None = None, folder: str | None = None) -> Index:
    """Index ``docs``: one shuffle of texts (sorted by scope and id), within whose parts terms are counted, and one of postings, to their terms."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark)
    scoped = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    chars = docs.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    parts = parts_of(spark, chars, PART_CHARS)
    dealt = docs.select(scoped.alias("scope"), F.col(id_column).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(parts, "scope", "doc_id").sortWithinPartitions("scope", "doc_id")
    at = F.monotonically_increasing_id()
    own = dealt.select("scope", "doc_id", F.shiftright(at, SEGMENT.bit_length() - 1).alias("segment"), tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    each = own.select("scope", "doc_id", "segment", F.size("tokens").alias("len"), F.explode(F.array_append("tokens", F.lit(None))).alias("term"))
    counted = each.groupBy("scope", "doc_id", "segment", "len", "term").agg(F.count("*").cast("int").alias("tf"))
    postings = F.array_sort(F.collect_list(F.struct("doc_id", "tf", "len"))).alias("postings")  # at most SEGMENT, or one id's rows
    blocks = counted.repartition(parts, "term", "scope", "segment").groupBy("term", "scope", "segment").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), postings)
    span = F.shiftright("segment", SPAN.bit_length() - 1).alias("span")
    blocks.select("term", "scope", "segment", span, "n", "max_tf", "min_len", "postings").sortWithinPartitions("term", "scope", "segment").write.parquet(f"{folder}/blocks")
    index = Index(spark, folder)
    terms = index.blocks.filter("term is not null")
    terms.select("term", "scope", "span", "max_tf", "min_len").repartition(parts, "term", "scope", "span").groupBy("term", "scope", "span").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len")).write.parquet(f"{folder}/spans")
    terms.select("term", "scope", "n").repartition(parts, "term", "scope").groupBy("term", "scope").agg(F.sum("n").alias("df")).write.parquet(f"{folder}/frequencies")
    sizes = F.aggregate("postings", F.lit(0).cast("bigint"), lambda s, p: s + p["len"])
    index.blocks.filter("term is null").groupBy("scope").agg(F.sum("n").alias("n_docs"), F.sum(sizes).alias("n_tokens")).write.parquet(f"{folder}/scopes")
    return index


def impact(tf: Column, size: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    """A posting's share of a score, without its term's weight: grows with ``tf``, falls with ``size``."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avg_len))


def weighed(index: Index, terms: DataFrame, per_scope: bool) -> DataFrame:
    """``terms`` (query_id, term, times) with weight and mean length, of each scope or of all scopes together."""
    wanted = small(terms)
    if per_scope:
        stats = index.scopes.select("scope", "n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avg_len"))
        found = index.frequencies.join(wanted, "term").join(stats, "scope")
        return found.select("query_id", "scope", "term", (F.col("times") * idf()).alias("weight"), "avg_len")
    stats = index.scopes.agg(F.sum("n_docs").alias("n_docs"), (F.sum("n_tokens") / F.sum("n_docs")).alias("avg_len"))  # one row
    found = index.frequencies.join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    return found.join(wanted, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("times") * idf()).alias("weight"), "avg_len")


@dataclass(frozen=True)
class Found:
    """``hits``: query_id, scope, doc_id, score, rank. ``report``: for each question (and scope) how many segments and blocks hold its terms, and how many were read."""

    hits: DataFrame
    report: DataFrame


def search(index: Index, terms: DataFrame, k: int, per_scope: bool = False, digits: int | None = None, folder: str | None = None) -> Found:
    """The ``k`` best documents of each question (of each scope, with statistics of its own, if ``per_scope``). ``digits``: scores count rounded.

    What goes to Spark's joins is bounded by the questions' terms and the segments that bounds leave open; tables are kept below ``folder``.
    """
    spark = index.spark
    folder = folder or new_folder(spark)
    weights = kept(weighed(index, terms, per_scope), f"{folder}/weights")
    by = ["query_id", "scope"] if per_scope else ["query_id"]
    on = ["scope", "term"] if per_scope else ["term"]
    slack = 10.0**-digits if digits is not None else 1e-9
    held = small(weights)
    parts = pair_parts(index, terms)

    def bounded(level: DataFrame, at: list[str]) -> DataFrame:
        own = level.join(held, on).groupBy("query_id", *at).agg(F.sum(F.col("weight") * impact(F.col("max_tf"), F.col("min_len"), F.col("avg_len"))).alias("bound"), F.count("*").alias("n_blocks"))
        return own

    def best(rows: DataFrame, *tie: str) -> DataFrame:
        return ranked(rows, SEEDS, by, *tie, score="bound").drop("rank")

    def scored(chosen: DataFrame) -> DataFrame:
        rows = index.blocks.filter("term is not null").select("term", "scope", "segment", "postings").join(held, on)
        rows = rows.join(small(chosen.select("query_id", "scope", "segment")), ["query_id", "scope", "segment"])
        rows = rows.repartition(parts, "query_id", "scope", "segment")  # whole blocks; their documents meet in these partitions
        each = rows.select("query_id", "scope", "segment", "weight", "avg_len", F.explode("postings").alias("p"))
        part = F.col("weight") * impact(F.col("p.tf"), F.col("p.len"), F.col("avg_len"))
        total = F.sum(part) if digits is None else F.round(F.sum(part), digits)
        return each.groupBy("query_id", "scope", "segment", F.col("p.doc_id").alias("doc_id")).agg(total.alias("score"))

    spans = kept(bounded(index.spans, ["scope", "span"]), f"{folder}/span_bounds")
    light = index.blocks.filter("term is not null").select("term", "scope", "segment", "span", "max_tf", "min_len")

    def opened(some: DataFrame) -> DataFrame:
        """Bounds of the segments of ``some`` spans (query_id, scope, span)."""
        rows = light.join(held, on).join(small(some.select("query_id", "scope", "span")), ["query_id", "scope", "span"])
        bound = F.sum(F.col("weight") * impact(F.col("max_tf"), F.col("min_len"), F.col("avg_len")))
        return rows.groupBy("query_id", "scope", "span", "segment").agg(bound.alias("bound"), F.count("*").alias("n_blocks"))

    seeds = kept(best(opened(best(spans, "scope", "span")), "scope", "segment"), f"{folder}/seeds")
    first = kept(scored(seeds), f"{folder}/first")
    kth = ranked(first, k, by, "doc_id").filter(F.col("rank") == k).select(*by, F.col("score").alias("least"))
    reach = F.coalesce("least", F.lit(0.0)) <= F.col("bound") + slack
    alive = spans.join(F.broadcast(kth), by, "left").filter(reach).drop("least")  # a row a question (and scope)
    open_ = kept(opened(alive).join(F.broadcast(kth), by, "left").filter(reach).drop("least"), f"{folder}/open")
    rest = scored(open_.join(seeds.select("query_id", "scope", "segment"), ["query_id", "scope", "segment"], "left_anti"))
    hits = ranked(first.unionByName(rest).drop("segment"), k, by, "doc_id")
    read = open_.select("query_id", "scope", "segment", "n_blocks").unionByName(seeds.select("query_id", "scope", "segment", "n_blocks")).distinct()
    read = read.groupBy(*by).agg(F.count("*").alias("segments_read"), F.sum("n_blocks").alias("blocks_read"))
    whole = light.join(held, on).groupBy("query_id", "scope", "segment").agg(F.count("*").alias("n")).groupBy(*by).agg(F.count("*").alias("segments"), F.sum("n").alias("blocks"))
    return Found(hits, whole.join(read, by))
