"""Hybrid retrieval for batches of questions: cosine, BM25 and structure in one weighted score, within each question's scope."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.planner import strings
from ..functions.text import let, tokens
from ..settings import DEFAULT, Settings
from . import bm25
from .lineage import settled, small
from .matching import contained


def structure_score(kind: Column, content: Column, preferred: Column, quoted: Column) -> Column:
    """Half for a preferred kind, half for a quoted term in the content, one at most."""
    named = F.exists(quoted, lambda t: F.contains(F.lower(content), F.lower(t)))
    return F.least(F.when(F.array_contains(preferred, kind), 0.5).otherwise(0.0) + F.when(named, 0.5).otherwise(0.0), F.lit(1.0))


def structure_scores(chunks: DataFrame, plans: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, structure_score, bonus) of the chunks in each question's scope. ``plans``: the stated set of questions, taken in blocks; each block's quoted
    terms are sought in one pass over each text, and pairs carry numbers only."""
    own = plans.select("query_id", "doc_kinds", "preferred_chunk_kinds", "article_refs", "annex_refs", F.transform(F.coalesce("quoted_terms", F.array().cast("array<string>")), F.lower).alias("quoted"))
    out = None
    number = max(1, -(-own.count() // MOST_QUESTIONS))
    for at in range(number):
        block = own.filter(F.pmod(F.xxhash64("query_id"), F.lit(number)) == at)
        terms = [r.t for r in block.select(F.explode("quoted").alias("t")).distinct().orderBy("t").collect()]  # of a block's questions
        named = strings(tuple(terms))
        asked = block.withColumn("quoted", F.transform("quoted", lambda t: F.array_position(named, t).cast("int") - 1)) if terms else block.withColumn("quoted", F.array().cast("array<int>"))
        found = chunks.select("chunk_id", "doc_kind", "chunk_kind", "article_num", "section_path", contained(F.lower(F.col("content")), terms).alias("named"))
        pairs = in_scope(found.crossJoin(F.broadcast(asked)), F.col("doc_kinds"), F.col("doc_kind"))  # MOST_QUESTIONS rows or so
        kind = F.when(F.array_contains("preferred_chunk_kinds", F.col("chunk_kind")), 0.5).otherwise(0.0)
        score = F.least(kind + F.when(F.arrays_overlap("quoted", "named"), 0.5).otherwise(0.0), F.lit(1.0))
        bonus = reference_bonus(F.col("article_num"), F.col("section_path"), F.col("article_refs"), F.col("annex_refs"), settings.reference_bonus)
        rows = pairs.select("query_id", "chunk_id", score.alias("structure_score"), bonus.alias("bonus"))
        out = rows if out is None else out.unionByName(rows)
    return out


def reference_bonus(article_num: Column, path: Column, articles: Column, annexes: Column, bonus: float = DEFAULT.reference_bonus) -> Column:
    """For a chunk of an article or annex that the question names. Annexes match as text, so "Annex I" is found in "Annex II" too."""
    named = F.coalesce(F.array_contains(articles, article_num), F.lit(False))
    return F.when(named | F.coalesce(F.exists(annexes, lambda a: F.contains(path, a)), F.lit(False)), bonus).otherwise(0.0)


def blend(semantic: Column, keyword: Column, structure: Column, bonus: Column, settings: Settings = DEFAULT) -> Column:
    return settings.semantic_weight * semantic + settings.keyword_weight * keyword + settings.structure_weight * structure + bonus


def in_scope(pairs: DataFrame, wanted: Column, kind: Column, strict: bool = False) -> DataFrame:
    """Rows whose kind the question wants; where no row of a question has one, all its rows (none if ``strict``). An empty list wants all.

    Whether a question has any is one small aggregate, joined back, so no question's rows are brought together.
    """
    flagged = pairs.withColumn("__in", (F.size(wanted) == 0) | F.coalesce(F.array_contains(wanted, kind), F.lit(False)))
    if strict:
        return flagged.filter("__in").drop("__in")
    any_in = flagged.groupBy("query_id").agg(F.max("__in").alias("__any"))
    return flagged.join(any_in, "query_id").filter(F.col("__in") | ~F.col("__any")).drop("__in", "__any")


#: Questions that one pass over the corpus takes.
MOST_QUESTIONS = 256
SCORED = (
    "query_id bigint, chunk_id bigint, doc_kind string, chunk_kind string, semantic_score double, keyword_score double, structure_score double, score double"
)


@dataclass(frozen=True)
class Asked:
    """One block of questions, as rows on the driver (``MOST_QUESTIONS`` at most)."""

    rows: list[Row]

    @property
    def terms(self) -> list[str]:
        return sorted({t for r in self.rows for t in r.tokens})

    @property
    def quoted(self) -> list[str]:
        return sorted({t.lower() for r in self.rows for t in r.quoted_terms or ()})

    @property
    def vectors(self) -> np.ndarray:
        """Unit vectors, shorter ones filled up with zeros; a null or zero vector stays zero."""
        wide = max((len(r.query_vector or ()) for r in self.rows), default=0)
        out = np.zeros((len(self.rows), wide))
        for i, r in enumerate(self.rows):
            out[i, : len(r.query_vector or ())] = r.query_vector or ()
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def blocks(questions: DataFrame) -> Iterator[Asked]:
    """Planned questions in blocks of about ``MOST_QUESTIONS``."""
    plans = questions.select("query_id", "query_vector", "doc_kinds", "preferred_chunk_kinds", "quoted_terms", "article_refs", "annex_refs", tokens(F.col("question")).alias("tokens"))
    number = -(-plans.count() // MOST_QUESTIONS)
    block = F.pmod(F.xxhash64("query_id"), F.lit(number))
    for at in range(number):
        rows = plans.filter(block == at).orderBy("query_id").collect()
        for start in range(0, len(rows), MOST_QUESTIONS):
            yield Asked(rows[start : start + MOST_QUESTIONS])


def similarities(embedding: Column, vectors: np.ndarray) -> Column:
    """The cosine of a chunk's embedding with each question's vector, as an array; over the shorter length, 0 for a null or zero embedding."""

    @F.arrow_udf("array<double>")
    def each(values: pa.Array) -> pa.Array:
        count, wide = len(vectors), vectors.shape[1]
        rows = np.zeros((len(values), wide))
        size = np.zeros(len(values))
        lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(pc.list_flatten(values), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.cumsum(lengths) - lengths
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            if length:
                part = flat[at[own][:, None] + np.arange(length)]
                size[own] = np.sqrt((part * part).sum(axis=1))
                rows[own, : min(length, wide)] = part[:, :wide]
        out = np.divide(rows @ vectors.T, size[:, None], out=np.zeros((len(values), count)), where=size[:, None] > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * count, pa.int32()), pa.array(out.ravel()))

    return each(embedding)


def features(chunks: DataFrame, asked: Asked) -> DataFrame:
    """What the questions need of each chunk, computed once: length, counts of their terms, their quoted terms in it, and similarities. The text goes no further."""
    wanted = strings(tuple(asked.terms))
    named = strings(tuple(asked.quoted))

    def counted(own: Column) -> Column:
        hits = let(F.array_intersect(own, wanted), lambda terms: F.struct(terms.alias("terms"), F.filter(own, lambda t: F.array_contains(terms, t)).alias("all")))
        postings = let(hits, lambda h: F.transform(h["terms"], lambda t: F.struct(t.alias("term"), F.size(F.filter(h["all"], lambda x: x == t)).alias("tf"))))
        return F.struct(F.size(own).alias("len"), postings.alias("postings"))

    rows = chunks.withColumn("__hits", contained(F.lower(F.col("content")), asked.quoted)) if asked.quoted else chunks
    quoted = F.transform("__hits", lambda n: F.element_at(named, n + 1)) if asked.quoted else named
    return rows.select(
        "chunk_id", "doc_kind", "chunk_kind", "article_num", "section_path", let(tokens(F.col("content")), counted).alias("counts"), quoted.alias("named"),
        similarities(F.col("embedding"), asked.vectors).alias("similar"),
    ).select("chunk_id", "doc_kind", "chunk_kind", "article_num", "section_path", "counts.len", "counts.postings", "named", "similar")


def weighed(asked: Asked, own: DataFrame, settings: Settings, strict: bool, by_kind: bool) -> DataFrame:
    """The questions with their scope (kinds) and that scope's BM25 weights; ``by_kind``: a row for each kind in scope.

    Statistics are summed for each kind, of which there are few by construction, and added up to scopes here.
    """
    lengths = {r.doc_kind: (r.n, r.total) for r in own.groupBy("doc_kind").agg(F.count("*").alias("n"), F.sum("len").alias("total")).collect()}
    found = own.select("doc_kind", F.explode("postings.term").alias("term")).groupBy("doc_kind", "term").agg(F.count("*").alias("n")).collect()
    often = {(r.doc_kind, r.term): r.n for r in found}
    rows = []
    for number, r in enumerate(asked.rows):
        wanted = [k for k in lengths if k in r.doc_kinds] if r.doc_kinds else list(lengths)
        inside = wanted if wanted or strict else list(lengths)
        times = Counter(r.tokens)
        for kinds in [[k] for k in inside] if by_kind else [inside]:
            n, total = (sum(lengths[k][i] for k in kinds) for i in (0, 1))
            weights = {}
            for term, count in times.items():
                if df := sum(often.get((k, term), 0) for k in kinds):
                    weights[term] = count * math.log(1 + (n - df + 0.5) / (df + 0.5))
            rows.append((number, r.query_id, kinds, weights, total / n if n else 0.0, r.preferred_chunk_kinds, [t.lower() for t in r.quoted_terms or ()], r.article_refs, r.annex_refs))
    schema = "number int, query_id bigint, kinds array<string>, weights map<string,double>, avg_len double, preferred array<string>, quoted array<string>, article_refs array<int>, annex_refs array<string>"
    return own.sparkSession.createDataFrame(rows, schema)


def scored(questions: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT, strict: bool = False, by_kind: bool = False) -> DataFrame:
    """(query_id, chunk_id, doc_kind, chunk_kind, scores) of all chunks in each question's scope.

    ``questions``: planned, with ``query_id``, ``question`` and ``query_vector``. ``chunks``: with ``chunk_id``, ``doc_kind``, ``content``, ``embedding``.
    Every question meets every chunk of its scope (the cosine needs it): questions are the stated query set and come in blocks. Each chunk's text is
    read once for a block; pairs carry numbers only. BM25 statistics are those of the scope: with ``by_kind`` each kind is a scope of its own, else a
    question's kinds together are, or the corpus. A question whose kinds no chunk has sees all chunks, or none if ``strict``.
    """
    out = None
    for asked in blocks(questions):
        own = settled(features(chunks, asked))
        plans = F.broadcast(weighed(asked, own, settings, strict, by_kind))  # at most MOST_QUESTIONS rows a kind
        pairs = own.select("*", F.posexplode("similar").alias("number", "semantic_score")).join(plans, "number").filter(F.array_contains("kinds", F.col("doc_kind")))
        k1, b = settings.bm25_k1, settings.bm25_b
        rarity = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
        raw = F.aggregate("postings", F.lit(0.0), lambda s, p: s + F.coalesce(F.try_element_at("weights", p["term"]), F.lit(0.0)) * p["tf"] * (k1 + 1) / (p["tf"] + rarity))
        structure = F.least(F.when(F.array_contains(F.col("preferred"), F.col("chunk_kind")), 0.5).otherwise(0.0) + F.when(F.arrays_overlap("quoted", "named"), 0.5).otherwise(0.0), F.lit(1.0))
        bonus = reference_bonus(F.col("article_num"), F.col("section_path"), F.col("article_refs"), F.col("annex_refs"), settings.reference_bonus)
        numbers = pairs.select("query_id", "chunk_id", "doc_kind", "chunk_kind", "semantic_score", raw.alias("raw"), structure.alias("structure_score"), bonus.alias("bonus"))
        by = ["query_id", "doc_kind"] if by_kind else ["query_id"]
        top = numbers.groupBy(*by).agg(F.max("raw").alias("top"))
        both = numbers.join(F.broadcast(top), by).withColumn("keyword_score", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0))  # a row for each question and kind
        total = blend(F.col("semantic_score"), F.col("keyword_score"), F.col("structure_score"), F.col("bonus"), settings)
        found = both.withColumn("score", total).drop("raw", "top", "bonus").select("query_id", "chunk_id", "doc_kind", "chunk_kind", "semantic_score", "keyword_score", "structure_score", "score")
        out = found if out is None else out.unionByName(found)
    return chunks.sparkSession.createDataFrame([], SCORED) if out is None else out


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` with their chunks' columns; a few rows for each question meet the corpus, whose texts stay where they are."""
    return small(settled(hits)).join(chunks.drop("embedding", "doc_kind", "chunk_kind"), "chunk_id")


def retrieve(questions: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT, k: int | None = None) -> DataFrame:
    """The ``k`` best chunks of each question (0 or none: the default), ties by chunk id."""
    return with_chunks(bm25.ranked(scored(questions, chunks, settings), k or settings.top_k, ["query_id"], "chunk_id"), chunks)


def retrieve_per_kind(questions: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT, k: int | None = None) -> DataFrame:
    """The best chunks of each kind in scope, each kind with statistics of its own; without fallback."""
    return with_chunks(bm25.ranked(scored(questions, chunks, settings, strict=True, by_kind=True), k or settings.per_kind, ["query_id", "doc_kind"], "chunk_id"), chunks)


def confidence(hits: DataFrame, preferred: str = "preferred_chunk_kinds") -> DataFrame:
    """(query_id, confidence) of ranked hits: the best hit's strength, its lead over the next, and whether its kind was preferred.

    ``hits``: query_id, rank, score, semantic_score, chunk_kind and the question's preferred kinds.
    """
    top = hits.filter(F.col("rank") <= 2).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("semantic_score"))).alias("semantic"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, F.when((F.size(preferred) == 0) | F.array_contains(F.col(preferred), F.col("chunk_kind")), 1.0).otherwise(0.55))).alias("agreement"),
    )
    return top.select("query_id", F.bround(confidence_of(F.col("semantic"), F.col("first"), F.col("second"), F.col("agreement")), 3).alias("confidence"))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def confidence_of(semantic: Column, first: Column, second: Column, agreement: Column) -> Column:
    lead = F.when(second.isNull() | (first <= 0), F.lit(0.3)).otherwise((first - second) / F.when(first > 0, first))
    return clamp(0.55 * clamp(semantic / 0.75) + 0.25 * clamp(lead * 2.5) + 0.20 * agreement)


def with_margin(hits: DataFrame) -> DataFrame:
    """Hits with the next hit's score beside."""
    return hits.withColumn("next_score", F.lead("score").over(Window.partitionBy("query_id").orderBy("rank")))
