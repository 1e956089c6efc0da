"""Text functions as column expressions: tokens, sentences, citations, answer checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed list.
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the to was were "
    "what which who with does do how when where why"
).split()

#: Fixed list: how an answer says that the documents don't hold it.
REFUSALS = (
    "do not contain this information",
    "does not contain this information",
    "do not contain enough information",
    "does not contain enough information",
    "not contain any information",
    "no information about",
    "cannot answer",
    "unable to answer",
)
#: The sentence that says so, and where sentences end.
NO_ANSWER = "The provided documents do not contain this information."
SENTENCE_BREAK = r"(?<=[.;:])(?U)\s+(?=[A-Z(\d])|\n+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: a lambda would compute it anew for each element."""
    return F.transform(F.array(value), body)[0]


RUN = 256


def starts(sizes: Column) -> Column:
    """The sum of the sizes before each one. Sums are taken within runs of ``RUN`` and then over the runs, so a long array costs no square of it."""
    empty = F.array().cast("array<int>")

    def step(state: Column, size: Column) -> Column:
        return F.struct((state["at"] + size).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def joined(state: Column, own: Column) -> Column:
        moved = F.transform(own["out"], lambda at: at + state["at"])
        return F.struct((state["at"] + own["at"]).alias("at"), F.concat(state["runs"], F.array(moved)).alias("runs"))

    def summed(own: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int"))
        runs = F.transform(numbers, lambda n: F.aggregate(F.slice(own, n * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
        whole = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("runs")), joined, lambda s: F.flatten(s["runs"]))
        return F.when(F.size(own) > 0, whole).otherwise(empty)

    return let(sizes, summed)


def strip(text: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, two long at least, no stop words; repeats stay, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def sentences(text: Column) -> Column:
    """Array of (start, end, sentence) with code point offsets, end exclusive; blank pieces are left out. Each piece starts where the pieces and
    breaks before it end, so the text is not searched for it."""

    def sized(own: Column) -> Column:
        return F.transform(own["pieces"], lambda piece, at: F.length(piece) + F.coalesce(F.length(F.get(own["breaks"], at)), F.lit(0)))

    def span(piece: Column, at: Column) -> Column:
        start = at + F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)^\s+", ""))
        return let(strip(piece), lambda bare: F.struct(start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("sentence")))

    def spans(own: Column) -> Column:
        found = let(starts(sized(own)), lambda at: F.transform(own["pieces"], lambda piece, i: span(piece, at[i])))
        return F.filter(found, lambda s: s["end"] > s["start"])

    parts = F.struct(F.split(text, SENTENCE_BREAK, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(SENTENCE_BREAK), 0).alias("breaks"))
    return F.when(text.isNotNull(), let(parts, spans))


def overlap(sentence: Column, answer_tokens: Column) -> Column:
    """Share of a sentence's distinct tokens that the answer has too, as if it had six at least."""
    return let(F.array_distinct(tokens(sentence)), lambda own: F.size(F.array_intersect(own, answer_tokens)) / F.greatest(F.size(own), F.lit(6)))


def supporting_spans(content: Column, answer: Column, least: float = 0.34, most: int = 3) -> Column:
    """The best-supported sentences of ``content`` as (start, end, score), at most ``most``, in text order."""

    def best(words: Column) -> Column:
        scored = F.transform(sentences(content), lambda s: F.struct((-overlap(s["sentence"], words)).alias("order"), s["start"].alias("start"), s["end"].alias("end")))
        good = F.slice(F.array_sort(F.filter(scored, lambda s: -s["order"] >= least)), 1, most)
        return F.array_sort(F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.bround(-s["order"], 3).alias("score"))))

    return let(F.array_distinct(tokens(answer)), best)


def clamped_spans(spans: Column, length: Column) -> Column:
    """Spans cut to the text and to what earlier ones have not covered; empty ones go."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, span: Column) -> Column:
        start = F.greatest(span["start"], state["at"], F.lit(0))
        end = F.least(span["end"], length)
        item = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.when(start < end, F.struct(end.cast("int").alias("at"), F.concat(state["out"], F.array(item)).alias("out"))).otherwise(state)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[([^\]]+)\]"), 1), strip)


def is_refusal(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(REFUSALS))


def is_degenerate(answer: Column) -> Column:
    """Fewer than half of the answer's sentences over 25 characters are distinct, of four or more."""
    long_ones = F.filter(F.transform(F.split(F.lower(answer), r"[.\n]+"), strip), lambda s: F.length(s) > 25)
    return (F.size(long_ones) >= 4) & (F.size(F.array_distinct(long_ones)) / F.greatest(F.size(long_ones), F.lit(1)) < 0.5)


def has_unsupported_citation(answer: Column, labels: Column) -> Column:
    """A bracketed citation agrees with no known label: neither starts with the other's first twelve characters, in lower case."""
    known = F.filter(F.transform(labels, F.lower), lambda k: F.length(k) > 0)

    def supported(cited: Column) -> Column:
        return F.exists(known, lambda k: F.startswith(k, F.substring(cited, 1, 12)) | F.startswith(cited, F.substring(k, 1, 12)))

    return F.exists(F.transform(citations(answer), F.lower), lambda c: ~supported(c))


def validated(answer: Column, labels: Column, confidence: Column, least: float = 0.35) -> Column:
    """(answer, warnings): an empty or repetitive answer is replaced; unsupported citations and low confidence are warned of."""
    own = strip(answer)
    none = F.lit(None).cast("string")
    replaced = (F.length(own) == 0) | is_degenerate(own)
    only = F.when(F.length(own) == 0, F.lit("empty answer")).otherwise(F.lit("repetitive answer"))
    cited = F.when(has_unsupported_citation(own, labels), F.lit("unsupported citation")).otherwise(none)
    low = F.when((confidence < least) & ~F.contains(F.lower(own), F.lit(NO_ANSWER.lower())), F.lit("low confidence")).otherwise(none)
    warnings = F.when(replaced, F.array(only)).otherwise(F.array_compact(F.array(cited, low)))
    return F.struct(F.when(replaced, F.lit(NO_ANSWER)).otherwise(own).alias("answer"), warnings.alias("warnings"))


def size_label(size: Column) -> Column:
    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("bigint")))
        .when(size < 1024 * 1024, F.format_string("%d KB", F.round(size / 1024).cast("bigint")))
        .otherwise(F.format_string("%.1f MB", size / (1024 * 1024)))
    )


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.6, "high").when(confidence >= 0.35, "medium").otherwise("low")
