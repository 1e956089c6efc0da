"""Queries on tokens, BM25 and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import bm25, clusters, postings
from .registry import ORACLES, query, table

STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
LITERAL = "the attion of inre que des ereading haed the"


def tok(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


TOKENS = f"toks AS (SELECT doc_id, lang, {tok('text')} AS tokens FROM documents)"
TF = f"WITH {TOKENS}, tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest(tokens) AS term FROM toks) GROUP BY ALL)"
QUERY_TERMS = f"qt AS (SELECT term, count(*) AS times FROM (SELECT unnest({tok(repr(LITERAL))}) AS term) GROUP BY term)"


def scored_sql(scope: str = "") -> str:
    """BM25 of the literal question, with statistics per ``scope``."""
    by = f"{scope}, " if scope else ""
    using = f"USING ({scope})" if scope else "ON true"
    return (
        f"{TF}, {QUERY_TERMS}, st AS (SELECT {by} count(*) AS n, avg(len(tokens)) AS a FROM toks GROUP BY ALL), "
        f"df AS (SELECT {by} term, count(*) AS df FROM tf GROUP BY ALL), "
        f"sc AS (SELECT tf.doc_id, {'tf.' + scope + ', ' if scope else ''} sum(times * ln(1 + (n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(toks.tokens) / a))) AS score "
        f"FROM tf JOIN qt USING (term) JOIN df ON df.term = tf.term {f'AND df.{scope} = tf.{scope}' if scope else ''} JOIN st {'ON st.' + scope + ' = tf.' + scope if scope else using} JOIN toks ON toks.doc_id = tf.doc_id GROUP BY ALL)"
    )


def tokenised(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return bm25.tokenised(table(spark, sf_dir, "documents"), "doc_id", "text", *keep)


def literal(spark: SparkSession) -> DataFrame:
    return bm25.query_terms(spark.range(1).select(F.lit(0).cast("bigint").alias("id"), F.lit(LITERAL).alias("q")), "id", "q")


@query(f"WITH {TOKENS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_distinct FROM toks")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark, sf_dir).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("bigint").alias("n_distinct"))


@query(f"{TF} SELECT doc_id, term, tf FROM tf")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_frequencies(tokenised(spark, sf_dir))


@query(f"{TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_frequencies(bm25.term_frequencies(tokenised(spark, sf_dir)))


@query(f"WITH {TOKENS} SELECT lang, count(*) AS n_docs, round(avg(len(tokens)), 6) AS avg_len, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM toks GROUP BY lang")
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.length_stats(tokenised(spark, sf_dir, "lang"), "lang").withColumn("avg_len", F.round("avg_len", 6))


@query(f"{TF} SELECT term, round(ln(1 + ((SELECT count(*) FROM toks) - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term)")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tokenised(spark, sf_dir)
    stats = bm25.length_stats(own)
    return bm25.document_frequencies(bm25.term_frequencies(own)).crossJoin(F.broadcast(stats)).select("term", F.round(bm25.idf(), 6).alias("idf"))


@query(f"{scored_sql()} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.scores(tokenised(spark, sf_dir), literal(spark)).withColumn("score", F.round("score", 6))
    return bm25.ranked(found, 20, ["query_id"], "doc_id").select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"{scored_sql()} SELECT doc_id, round(CASE WHEN (SELECT max(score) FROM sc) > 0 THEN coalesce(score, 0) / (SELECT max(score) FROM sc) ELSE 0 END, 6) AS score FROM toks LEFT JOIN sc USING (doc_id)")
def bm25_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tokenised(spark, sf_dir)
    found = own.select("doc_id").join(bm25.scores(own, literal(spark)), "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return bm25.normalised(found).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{scored_sql('lang')} SELECT lang, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 5")
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language is a scope with statistics of its own; the best five of each."""
    found = bm25.scores(tokenised(spark, sf_dir, "lang"), literal(spark), "lang").withColumn("score", F.round("score", 6))
    return bm25.ranked(found, 5, ["query_id", "lang"], "doc_id").select("lang", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"{TF}, qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL), "
    "st AS (SELECT count(*) AS n, avg(len(tokens)) AS a FROM toks), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "sc AS (SELECT query_id, tf.doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(toks.tokens) / a))) AS score FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN st ON true JOIN toks ON toks.doc_id = tf.doc_id GROUP BY ALL) "
    "SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 5"
)
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question."""
    found = bm25.scores(tokenised(spark, sf_dir), batch_terms(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return bm25.ranked(found, 5, ["query_id"], "doc_id").select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def batch_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question."""
    return bm25.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(ORACLES["bm25_batch"])
def bm25_index_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bm25_batch`` from the block-max index, which reads only the segments that may hold them."""
    index = postings.build(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = postings.search(index, batch_terms(spark, sf_dir), 5, digits=6)
    return found.hits.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(ORACLES["bm25_scoped"])
def bm25_index_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bm25_scoped`` from the index: each language with statistics of its own."""
    index = postings.build(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = postings.search(index, literal(spark), 5, per_scope=True, digits=6)
    return found.hits.select(F.col("scope").alias("lang"), "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"{TF}, qt AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark)) "
    "SELECT query_id, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, true AS within FROM tf JOIN qt USING (term) GROUP BY query_id"
)
def bm25_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark text the documents that share a term with it, and whether the index opened no more blocks than hold its terms."""
    index = postings.build(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    terms = batch_terms(spark, sf_dir)
    report = postings.search(index, terms, 5, digits=6).report
    docs = index.blocks.join(terms.select("query_id", "term"), "term").select("query_id", F.explode("postings.doc_id").alias("doc_id"))
    counted = docs.repartition(postings.pair_parts(index, terms), "query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_docs"))
    return counted.join(report, "query_id").select("query_id", "n_docs", ((F.col("blocks_read") <= F.col("blocks")) & (F.col("segments_read") <= F.col("segments"))).alias("within"))


COSINE = "coalesce(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / nullif(sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 0), 0)"


def against_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with vector 0; a question is one row, so meeting it is a broadcast of that row."""
    own = table(spark, sf_dir, "embeddings")
    question = own.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    near = own.crossJoin(F.broadcast(question)).withColumn("score", F.round(vector.cosine(F.col("embedding"), F.col("q")), 6))
    return near.select("vec_id", "label", "score", F.lit(0).alias("query_id"))


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS score, row_number() OVER (ORDER BY round({COSINE}, 6) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0 QUALIFY rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.ranked(against_first(spark, sf_dir), 10, ["query_id"], "vec_id").select("vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT e.label, e.vec_id, round({COSINE}, 6) AS score, row_number() OVER (PARTITION BY e.label ORDER BY round({COSINE}, 6) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0 QUALIFY rank <= 3")
def cosine_per_label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.ranked(against_first(spark, sf_dir), 3, ["label"], "vec_id").select("label", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COSINE} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) QUALIFY rank <= 10"
)
def cosine_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth one among all, from clusters whose bounds leave the others unread."""
    own = table(spark, sf_dir, "embeddings")
    index = clusters.build(own, "vec_id", "embedding")
    found = clusters.search(index, own.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 10, digits=6)
    return found.hits.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("bigint").alias("rank"))


def hashed_sql(source: str, key: str) -> str:
    return (
        f"t AS (SELECT {key} AS id, md5(unnest({tok('text')})) AS h FROM {source}), "
        "p AS (SELECT id, CAST(('0x' || substr(h, 1, 8))::BIGINT % 128 AS INTEGER) AS position, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM t GROUP BY ALL), "
        "v AS (SELECT id, position, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY id)), 0) AS value FROM p)"
    )


@query(f"WITH {hashed_sql('documents', 'doc_id')} SELECT id AS doc_id, position, round(value, 6) AS value FROM v WHERE value <> 0")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash embeddings of all documents, as their non-zero positions."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vector.hash_embedding(F.col("text"))).alias("position", "value"))
    return own.filter("value <> 0").withColumn("value", F.round("value", 6))


@query(
    f"WITH {hashed_sql('conversations', 'conv_id * 1000 + turn')}, q AS (SELECT position, value FROM v WHERE id = (SELECT min(conv_id * 1000 + turn) FROM conversations)) "
    "SELECT conv_id, turn, round(coalesce(s, 0), 6) AS score FROM conversations LEFT JOIN (SELECT id, sum(v.value * q.value) AS s FROM v JOIN q USING (position) GROUP BY id) ON id = conv_id * 1000 + turn"
)
def hash_embed_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each turn's hash embedding with the first turn's."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", vector.hash_embedding(F.col("text")).alias("v"))
    first = table(spark, sf_dir, "conversations").orderBy(F.col("conv_id") * 1000 + F.col("turn")).limit(1).select(vector.hash_embedding(F.col("text")).alias("q"))
    return own.crossJoin(F.broadcast(first)).select("conv_id", "turn", F.round(vector.cosine(F.col("v"), F.col("q")), 6).alias("score"))
