"""Question planning by ordered rules: one wide projection, any number of questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: The cues of a question's type, types in the order in which they are tried.
CUES: dict[str, tuple[str, ...]] = {
    "comparison": (r"\bdifferences?\s+between\b", r"\bcompare\b", r"\bcompared\s+to\b", r"\bversus\b", r"\bvs\b", r"\bboth\b", r"\bdiffer\b"),
    "obligation": (r"\bobligation", r"\bwho\s+(must|shall|is\s+responsible)", r"\bresponsib", r"\brequired\s+to\b", r"\bduties\b", r"\bwhat\s+must\b", r"\bwhat\s+shall\b"),
    "definition": (r"\bwhat\s+(is|are)\b", r"\bdefine\b", r"\bdefinition\s+of\b", r"\bwhat\s+does\s+.+\s+mean\b", r"\bmeaning\s+of\b", r"\bwho\s+(is|are)\s+(a|an|the)\b", r"\bwho\s+qualifies\s+as\b"),
    "list": (r"\blist\b", r"\benumerate\b", r"\ball\s+the\b", r"\bwhich\s+.*\s+are\s+required\b"),
    "condition": (r"\bwhen\b", r"\bunder\s+what\s+(conditions|circumstances)\b", r"\bif\b", r"\bconditions?\s+for\b", r"\bexempt", r"\bderogat"),
    "procedure": (r"\bhow\s+(to|do|does|can)\b", r"\bprocedure\b", r"\bprocess\b", r"\bsteps\b"),
    "summary": (r"\bsummar", r"\boverview\b", r"\bin\s+short\b", r"\bexplain\b"),
}
#: How a question names a document kind.
SCOPES: dict[str, str] = {
    "mdr": r"\b(mdr|2017/745|medical\s+device\s+regulation)\b",
    "ivdr": r"\b(ivdr|2017/746|in\s*-?\s*vitro\s+diagnostic)\b",
}
#: Fixed values.
PREFERRED: dict[str, tuple[str, ...]] = {
    "definition": ("definition",),
    "obligation": ("obligation",),
    "list": ("list",),
    "condition": ("obligation", "list"),
    "procedure": ("obligation", "list"),
}
#: Characters that quote a term, and (below) the form of a question for a definition.
QUOTES = "'\"‘’“”"
DIRECT = ("definition", "list")
#: Fixed values.
PROMPT_OF = {"list": "list", "procedure": "list", "obligation": "obligation", "condition": "obligation"}


def found(text: Column, pattern: str) -> Column:
    return text.rlike("(?iU)" + pattern)


def any_of(cues: tuple[str, ...]) -> str:
    return "|".join(cues)


def question_type(text: Column) -> Column:
    out = None
    for name, cues in CUES.items():
        out = F.when(found(text, any_of(cues)), name) if out is None else out.when(found(text, any_of(cues)), name)
    return out.otherwise("general")


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def preferred_kinds(kind: Column) -> Column:
    out = None
    for name, kinds in PREFERRED.items():
        out = F.when(kind == name, strings(kinds)) if out is None else out.when(kind == name, strings(kinds))
    return out.otherwise(strings(()))


def doc_kinds(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(found(text, pattern), name) for name, pattern in SCOPES.items())))


def article_refs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)\barticle\s+([0-9]{1,3})\b"), 1), lambda n: n.cast("int"))


def annex_refs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)\bannex\s+([IVXLC]+|[0-9]+)\b"), 1), lambda n: F.concat(F.lit("Annex "), F.upper(n)))


def quoted_terms(text: Column) -> Column:
    """Text between any two quote characters, apostrophes included; 3 to 79 characters."""
    inner = F.transform(F.regexp_extract_all(text, F.lit(f"[{QUOTES}](.+?)[{QUOTES}]"), 1), strip)
    return F.filter(inner, lambda t: (F.length(t) > 2) & (F.length(t) < 80))


def subject_term(text: Column, kind: Column, quoted: Column, strict: bool = False) -> Column:
    """What a definition question is about. The article before the term needs no space after it, so "an importer" loses its "a" only
    ("n importer"), as users of such plans know it; ``strict`` wants whole articles."""
    article = r"(?:(?:a|an|the)\s+)?" if strict else r"(?:a|an|the)?"
    pattern = rf"(?iU)\b(?:what|who)\s+(?:is|are)\s+{article}\s*[{QUOTES}]?(.+?)[{QUOTES}]?\s*[?.]?\s*$"
    candidate = F.lower(F.regexp_replace(strip(F.regexp_extract(text, pattern, 1)), f"^[{QUOTES}]+|[{QUOTES}]+$", ""))
    named = F.when((F.length(candidate) > 2) & (F.length(candidate) < 60), candidate)
    return F.when(kind == "definition", F.when(F.size(quoted) > 0, F.lower(F.try_element_at(quoted, F.lit(1)))).otherwise(named))


def planned(questions: DataFrame, text: str = "question", strict: bool = False) -> DataFrame:
    """``questions`` with the plan's columns; the question is trimmed."""
    own = questions.withColumn(text, strip(F.col(text)))
    q = F.col(text)
    own = own.withColumns({"question_type": question_type(q), "doc_kinds": doc_kinds(q), "article_refs": article_refs(q), "annex_refs": annex_refs(q), "quoted_terms": quoted_terms(q)})
    both = (F.col("question_type") == "comparison") | (F.size("doc_kinds") == 2)
    own = own.withColumns({"preferred_chunk_kinds": preferred_kinds(F.col("question_type")), "is_comparison": both, "subject_term": subject_term(q, F.col("question_type"), F.col("quoted_terms"), strict)})
    return own.withColumn("allows_direct_answer", F.col("question_type").isin(*DIRECT) & ~F.col("is_comparison"))


def prompt_name(kind: Column) -> Column:
    out = None
    for name, prompt in PROMPT_OF.items():
        out = F.when(kind == name, prompt) if out is None else out.when(kind == name, prompt)
    return out.otherwise("answer")
