"""Quality rules: a decision list learned by sequential covering, emitted as one ordered Spark conditional expression.

Statistics of a text come from one Arrow function over whole texts. Learning takes labelled documents (at most ``MAX_LABELLED``, the
first by a hash of the id; a documented bound) and finds rules for "reject": each rule grows one threshold condition at a time by
information gain on the growing part, loses trailing conditions while that helps on the pruning part, and is kept if it is precise there;
the rows it covers leave, and the next rule is learned. The list becomes ``CASE WHEN`` in rule order, else "keep".

Defined cases: a null, empty or blank text has no words and fails the base rule; texts, lines and words of any length count whole; null ids pass
through; repeated rows get equal results, and a labelled id that repeats teaches once, by the least of its rows' statistics; an id with two
labels has the lesser; equal gains go to the first feature and threshold; an empty table gives an empty result; without labels there are no rules and
the base rule alone decides; columns of the input with any name are untouched, as all statistics travel in one column of an unused name.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, each_text, unused
from .mapped import returned

MAX_LABELLED = 20_000
BLANKS = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
RESERVED = "__lexloom_quality"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_doubled")
STAT_TYPE = "struct<" + ",".join(f"{s}:long" for s in STATS) + ">"
WINDOW = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, exactly: windows are numbered by doubling, words by first use."""
    count = len(words)
    if count <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    kinds = len(number)
    if kinds == count:
        return 0
    key, span = ids, 1
    while span < window:
        step = min(span, window - span)  # windows of span + step words, the two parts may not overlap unless step < span
        left, right = key[: count - span - step + 1], key[step : count - span + 1]
        _, key = np.unique(left * (int(key.max()) + 1) + right, return_inverse=True)
        span += step
        if int(key.max()) + 1 == len(key):
            return 0  # all distinct, so all longer ones are
    often = np.bincount(key)[key] > 1
    change = np.zeros(count + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change)[:count] > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    bare = text.translate(None, BLANKS + CONTINUATION)
    lines = [line for line in text.split(b"\n") if line.strip()]
    left = [len(text) - len(text.translate(None, some)) for some in (SYMBOLS, UPPER, DIGITS, b"!?")]
    doubled = sum(map(eq, words, words[1:]))
    return len(words), len(bare), left[0], len(lines) - len(set(lines)), repeated_words(words), len(lines), left[1], left[2], left[3], doubled


def stats(text: Column) -> Column:
    """A struct of ``STATS`` for each text; only the text column travels to Python, texts pass one at a time, and memory goes back between batches."""

    @F.arrow_udf(STAT_TYPE)
    def each(values: pa.Array) -> pa.Array:
        rows = np.zeros((len(values), len(STATS)), np.int64)
        for i, text in enumerate(each_text(values)):
            rows[i] = statistics(text)
        returned()
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=list(STATS))

    return each(text)


#: What rules may compare, each from the statistics struct; a ratio of nothing is 0.
FEATURES = {
    "n_words": ("n_words", None),
    "chars_a_word": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "dup_lines_a_line": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_a_word": ("n_marks", "n_words"),
    "doubled_share": ("n_doubled", "n_words"),
}


def feature(name: str, own: Column) -> Column:
    top, bottom = FEATURES[name]
    if bottom is None:
        return own[top].cast("double")
    return F.when(own[bottom] > 0, own[top] / own[bottom]).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, own: Column) -> Column:
        value = feature(self.feature, own)
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, values: np.ndarray) -> np.ndarray:
        value = values[:, list(FEATURES).index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self, own: Column) -> Column:
        out = self.conditions[0].column(own)
        for c in self.conditions[1:]:
            out = out & c.column(own)
        return out

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for c in self.conditions:
            out &= c.holds(values)
        return out


def best_condition(values: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the most information gain on these rows, over every threshold between two values."""
    total_bad, total = int(bad.sum()), len(bad)
    best: tuple[float, Condition | None] = (1e-9, None)
    prior = np.log2(total_bad / total)
    for i, name in enumerate(FEATURES):
        order = np.argsort(values[:, i], kind="stable")
        value, hits = values[order, i], np.cumsum(bad[order])
        cut = np.flatnonzero(value[:-1] < value[1:])
        if not len(cut):
            continue
        for above in (False, True):
            covered = (total - cut - 1) if above else cut + 1
            good = (total_bad - hits[cut]) if above else hits[cut]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(good > 0, good * (np.log2(np.maximum(good, 1) / covered) - prior), 0.0)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), Condition(name, above, float((value[cut[at]] + value[cut[at] + 1]) / 2)))
    return best


def learn(values: np.ndarray, bad: np.ndarray, most_rules: int = 16, most_conditions: int = 4, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Sequential covering with reduced-error pruning; rows 0 mod 3 prune, the others grow."""
    rules: list[Rule] = []
    prune = np.arange(len(bad)) % 3 == 0
    open_rows = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grow = open_rows & ~prune
        test = open_rows & prune
        if bad[grow].sum() < least or bad[test].sum() == 0:
            break
        conditions: list[Condition] = []
        inside = grow.copy()
        while len(conditions) < most_conditions and 0 < bad[inside].sum() < inside.sum():
            _, condition = best_condition(values[inside], bad[inside])
            if condition is None:
                break
            conditions.append(condition)
            inside &= condition.holds(values)
        scored = []
        for size in range(1, len(conditions) + 1):
            rule = Rule(tuple(conditions[:size]))
            hit = rule.holds(values) & test
            p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
            scored.append(((p - n) / max(1, p + n), -size, rule, p, n))
        if not scored:
            break
        _, _, rule, p, n = max(scored, key=lambda s: s[:2])
        if p < least or p < precision * (p + n):
            break
        rules.append(rule)
        open_rows &= ~rule.holds(values)
    return rules


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Feature values of at most ``most`` labelled documents and whether each is labelled bad."""
    own = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # most rows at most, so they may be broadcast
    text = docs.select(F.col("doc_id"), F.col("text"))
    rows = text.join(F.broadcast(own), "doc_id").select("doc_id", "quality", stats(F.col("text")).alias(RESERVED))
    one = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(RESERVED).alias(RESERVED))  # a row for each labelled id, however often it occurs
    out = one.select("doc_id", "quality", *(feature(f, F.col(RESERVED)).alias(f) for f in FEATURES)).toPandas().sort_values(["doc_id", *FEATURES])
    return out[list(FEATURES)].to_numpy(float), (out["quality"] == 0).to_numpy()


def fitted(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Rule]:
    values, bad = labelled(docs, labels, most)
    return learn(values, bad)


def base_failed(own: Column) -> Column:
    return (own["n_words"] < 10) | (own["n_repeat_words"] * 100 > own["n_words"] * 20)


def rule_number(rules: list[Rule], own: Column) -> Column:
    """The first rule that rejects, from 1; 0 if none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        out = F.when(rule.column(own), number) if out is None else out.when(rule.column(own), number)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add a struct column as the last: statistics, ``base_failed``, ``rule`` and ``kept``. It is named ``RESERVED``, or longer where the input has that name."""
    name = unused(docs, RESERVED)
    found = docs.withColumn(name, stats(F.col("text")))
    own = F.col(name)
    number = rule_number(rules, own)
    return found.withColumn(name, F.struct(*(own[s].alias(s) for s in STATS), base_failed(own).alias("base_failed"), number.alias("rule"), (~base_failed(own) & (number == 0)).alias("kept")))


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that neither the base rule nor the list rejects, with the input's columns."""
    found = judged(docs, rules)
    verdict = found.columns[-1]
    return found.filter(F.col(verdict)["kept"]).drop(verdict)


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = judged(docs.select("doc_id", "text"), rules).select("doc_id", RESERVED)
    return own.select("doc_id", *(F.col(f"{RESERVED}.{c}").alias(c) for c in (*STATS[:5], "base_failed", "kept", "rule")))
