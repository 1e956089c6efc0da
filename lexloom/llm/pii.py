"""Personal data and secrets: regular expressions propose spans, validators (checksums where a kind has one) confirm them, context words adjust the score.

DataFrame expressions only. A kind's matches come from ``regexp_extract_all`` and the texts between them from ``split`` by the same pattern. Starts are
running sums of both lengths (code points, end exclusive), taken within runs of ``RUN`` matches and then over the runs, so a text with very many
matches costs no square of them. A cheap test (``contains`` or ``rlike``) comes first, so that a text without a candidate is read once per kind.

Patterns are written so that matching is linear where the plain form would rescan a long run from each of its characters: a match may
start only where the run starts or where the last match ended (``\\G``), and inner repeats are possessive where giving back can't help.

Base kinds (email, ip, card, phone) are always reported once their validator agrees; their score is for ranking. The further kinds are reported if their
score reaches ``THRESHOLD``: a prior, ``CHECKED`` for a valid checksum, ``NEAR`` more if one of the kind's cues stands in the ``CONTEXT`` characters before or
after the span, and ``NEAR`` less if one of its counter-cues does. Context ends at the next match of the kind. So a valid iban is reported
unless it is called an example or a serial number, and a number in the form of a social security number only beside such words.

Defined cases: a null or empty text has no spans; a null id is passed through; repeated rows give repeated results; texts of any length, with any number
of matches, are read whole; spans of different kinds that overlap are all reported by ``detect``; an empty table gives an empty result;
columns of any name are kept (the added one is named ``RESERVED``, or longer where the input has that name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, unused

CONTEXT, RUN = 48, 256
THRESHOLD, CHECKED, NEAR = 0.6, 0.4, 0.3
RESERVED = "__lexloom_pii"
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    quick: str  # a literal that every match contains, or "" for a test by the pattern itself
    base: bool
    prior: float
    cues: str
    counter: str


SAMPLE = "example|sample|dummy|fake|placeholder|beispiel|ejemplo|exemple"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, "mail|contact|write", SAMPLE),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.5, "ip|address|host|server", "version|release|section|chapter"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", "", True, 0.5, "card|visa|credit|payment", f"order|serial|isbn|{SAMPLE}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.6, "tel|phone|call|mobile|fax", SAMPLE),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", False, 0.3, "iban|account|bank|konto|cuenta|compte", f"serial|part n|licen[cs]e|{SAMPLE}"),
    Kind("ssn", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "-", False, 0.35, "ssn|social security", f"serial|part n|order|{SAMPLE}"),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+", "", False, 0.35, "token|secret|passw|api.?key|access.?key|private.?key|bearer|credential|auth", f"sha|md5|checksum|digest|commit|revision|{SAMPLE}"),
)
#: Kinds with a checksum of their own.
SUMMED = ("card", "iban")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where the digits pass: from the right, every second one doubled, its digits summed."""

    def step(total: Column, at: Column) -> Column:
        digit = F.substring(number, -at, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(at % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where the account number, first four characters last and letters as 10 to 35, leaves 1."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, at: Column) -> Column:
        code = F.ascii(F.substring(turned, at, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.split(match, r"\.")
        return F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(parts, lambda p: F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 4).cast("int") <= 255)
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":  # hexadecimal, or small and capital letters with digits
        mix = match.rlike("[a-z]") & match.rlike("[A-Z]") | match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & match.rlike("[A-Fa-f]")
        return match.rlike("[0-9]") & mix
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)") & ~match.rlike("-00-") & ~match.rlike("-0000$")
    return F.lit(True)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def near(words: str, before: Column, after: Column) -> Column:
    pattern = rf"(?i)(?<![A-Za-z<])(?:{words})"  # not in a mask's name
    return before.rlike(pattern) | after.rlike(pattern)


def judged(kind: Kind, match: Column, before: Column, after: Column, context: int, threshold: float) -> tuple[Column, Column]:
    """Whether a match is reported, and its score; ``before`` and ``after`` are the texts up to the next matches."""
    left, right = F.right(before, F.lit(context)), F.left(after, F.lit(context))
    score = F.lit(kind.prior + (CHECKED if kind.name in SUMMED else 0.0)) + F.when(near(kind.cues, left, right), NEAR).otherwise(0.0) - F.when(near(kind.counter, left, right), NEAR).otherwise(0.0)
    score = F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2)
    ok = valid(kind.name, match)
    return ok if kind.base else ok & (score >= threshold), score


def parts(kind: Kind, text: Column) -> Column:
    """All matches and the texts around them: a struct of ``found`` (n) and ``between`` (n + 1)."""
    return F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("found"), F.split(text, kind.pattern, -1).alias("between"))


def maybe(kind: Kind, text: Column) -> Column:
    return F.contains(text, F.lit(kind.quick)) & text.rlike(kind.pattern) if kind.quick else text.rlike(kind.pattern)


def spans_of(no: int, kind: Kind, text: Column, context: int, threshold: float) -> Column:
    """The kind's spans in ``text`` as an array sorted by start."""
    empty = F.array().cast(SPAN)

    def item(own: Column, match: Column, at: Column) -> Column:
        before, after = own["between"][at], own["between"][at + 1]
        ok, score = judged(kind, match, before, after, context, threshold)
        return F.struct(F.length(before).alias("before"), F.length(match).alias("size"), ok.alias("ok"), score.alias("score"))

    def step(state: Column, one: Column) -> Column:
        start = state["at"] + one["before"]
        end = start + one["size"]
        span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind.name).alias("kind"), one["score"].alias("score"))
        return F.struct(end.alias("at"), F.when(one["ok"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def run(items: Column, number: Column) -> Column:
        return F.aggregate(F.slice(items, number * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)

    def moved(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), span["kind_no"].alias("kind_no"), (span["end"] + by).alias("end"), span["kind"].alias("kind"), span["score"].alias("score"))

    def joined(state: Column, own: Column) -> Column:
        shifted = F.transform(own["spans"], lambda s: moved(s, state["at"]))
        return F.struct((state["at"] + own["at"]).alias("at"), F.concat(state["runs"], F.array(shifted)).alias("runs"))

    def folded(items: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda n: run(items, n))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("runs")), joined, lambda s: F.flatten(s["runs"]))

    all_items = bound(parts(kind, text), lambda own: F.transform(own["found"], lambda match, at: item(own, match, at)))
    return F.when(maybe(kind, text), bound(all_items, folded)).otherwise(empty)


def detect(docs: DataFrame, text: str = "text", context: int = CONTEXT, threshold: float = THRESHOLD) -> DataFrame:
    """Add a column as the last: all spans by start, then kind as listed in ``KINDS``."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = [spans_of(no, kind, body, context, threshold) for no, kind in enumerate(KINDS)]
    return docs.withColumn(unused(docs, RESERVED), F.array_sort(F.concat(*found)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    n_base = sum(k.base for k in KINDS)
    return F.filter(spans, lambda s: s["kind_no"] < n_base)


def rewritten(kind: Kind, text: Column, context: int, threshold: float) -> Column:
    """The text with the kind's spans replaced."""

    def joined(own: Column) -> Column:
        def piece(match: Column, at: Column) -> Column:
            before, after = own["between"][at], own["between"][at + 1]
            ok, _ = judged(kind, match, before, after, context, threshold)
            return F.concat(before, F.when(ok, f"<{kind.name.upper()}>").otherwise(match))

        return F.concat(F.array_join(F.transform(own["found"], piece), ""), F.element_at(own["between"], -1))

    return F.when(maybe(kind, text), bound(parts(kind, text), joined)).otherwise(text)


def masked(docs: DataFrame, text: str = "text", n_chars: str | None = None, context: int = CONTEXT, threshold: float = THRESHOLD) -> DataFrame:
    """The input's columns with each span of personal data replaced by its kind in angle brackets, kind after kind as listed in ``KINDS``: a later
    kind is sought in what the earlier ones leave, so that of overlapping spans the earlier kind's is replaced. Each kind is one pass over
    the text. ``n_chars`` names a column that is to hold a changed text's length. A null text stays null."""
    name = unused(docs, RESERVED)
    out = docs.withColumn(name, F.col(text))
    for kind in KINDS:
        out = out.withColumn(name, rewritten(kind, F.col(name), context, threshold))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(name) != F.col(text), F.length(name)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType))
    return out.withColumn(text, F.col(name)).drop(name)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = detect(docs)
    spans = F.col(found.columns[-1])

    def count(kind: Kind) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")

    own = found.select("doc_id", spans.alias("found"))
    spans = F.col("found")
    counts = [count(kind) for kind in KINDS if kind.base]
    return own.select("doc_id", *counts, F.sha2(listed(base_spans(spans)), 256).alias("base_sha256"), listed(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))
