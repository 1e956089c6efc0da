"""Spelling variants: words one edit apart, found by wildcard groups without making their pairs.

Words stand in the order of their counts (largest first, then by code points), so a word is one number, its place, and the best of several words is the least.

Replacements: each position of a word gives the group (position, prefix, suffix) of all words that differ there alone. A group has at most one word
for each letter of the alphabet, and keeps its size and its two best words: a member has size - 1 near words in it, the best of them is the first word, or
the second for the first itself. Two words one replacement apart share one group.

Insertions and deletions: a word's distinct results of one deletion (one for each run of equal letters) join the vocabulary. A joined row counts for both of its words,
and adds to two sums; nothing is made for two words of one shorter word.

Prefixes, suffixes and deletions are compared as 64-bit hashes (two of them for a deletion), so rows have a fixed size however long a word is.
Forms at least double the count at each step, so chains are short; roots are found by pointer doubling.

Defined cases: null and empty texts have no words; a null id deletes nothing; an empty table, and one without words of that size and number, gives an
empty result; repeated rows count each; texts and runs of any length count whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, keep, shared_dir
from .numbering import numbered

LEAST_LENGTH, LEAST_COUNT, ONE_IN, RATIO = 5, 3, 97, 2
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of lower-cased text.
RUN = "[a-zÀ-ÿ]+"


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of the vocabulary as a join's side, to be shuffled: kept tables are compressed, so by their files' size Spark takes a million words for
    few bytes, and would build them whole on the driver to broadcast them."""
    return rows.hint("merge")


def observed(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """(word): each run of each text, lower-cased, with one letter gone from about one in ``one_in``, as a document's id and the run decide."""
    low = F.translate("text", UPPER, UPPER.lower())
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    crc = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary"))
    at = (crc % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.withColumn("crc", crc).select(F.when(F.col("crc") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def pieces() -> tuple[Column, Column]:
    """What precedes and follows the letter at ``at`` (from 1)."""
    return F.substring(F.col("word"), F.lit(1), F.col("at") - 1), F.substring(F.col("word"), F.col("at") + 1, F.length("word"))


def lettered(words: DataFrame) -> DataFrame:
    """(place, word, at): a row for each letter of each word."""
    return words.select("place", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))


def replaced(words: DataFrame) -> DataFrame:
    """(place, near, best) of each word and group of more than one."""
    prefix, suffix = pieces()
    keys = lettered(words).select("place", "at", F.xxhash64(prefix).alias("prefix"), F.xxhash64(suffix).alias("suffix"))
    groups = keys.groupBy("at", "prefix", "suffix").agg(F.sort_array(F.collect_list("place")).alias("members"))  # a word a letter at most
    groups = groups.filter(F.size("members") > 1).select(F.size("members").alias("size"), F.col("members")[0].alias("first"), F.col("members")[1].alias("second"), F.explode("members").alias("place"))
    return groups.select("place", (F.col("size") - 1).cast("long").alias("near"), F.when(F.col("place") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))


def hashes(word: Column) -> list[Column]:
    return [F.xxhash64(word).alias("one"), F.xxhash64(F.lit(1), F.reverse(word)).alias("two")]


def shortened(words: DataFrame) -> DataFrame:
    """(longer, shorter): words and those of the vocabulary that lack one of their letters."""
    prefix, suffix = pieces()
    first_of_run = (F.col("at") == 1) | (F.substring(F.col("word"), F.col("at"), F.lit(1)) != F.substring(F.col("word"), F.col("at") - 1, F.lit(1)))
    deleted = lettered(words).filter(first_of_run).select(F.col("place").alias("longer"), *hashes(F.concat(prefix, suffix)))
    return deleted.join(spread(words.select(F.col("place").alias("shorter"), *hashes(F.col("word")))), ["one", "two"]).select("longer", "shorter")


def nearest(words: DataFrame) -> DataFrame:
    """(place, n_near, best): each word's number of near words and the best of them."""
    edits = shortened(words)
    ends = edits.select(F.explode(F.array(F.struct(F.col("longer").alias("place"), F.col("shorter").alias("best")), F.struct(F.col("shorter").alias("place"), F.col("longer").alias("best")))).alias("end"))
    both = replaced(words).unionByName(ends.select("end.place", F.lit(1).cast("long").alias("near"), "end.best"))
    return both.groupBy("place").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame, folder: str) -> DataFrame:
    """(place, root) of the words that have a form: ``forms`` (place, root) followed to the last, twice as far each time."""
    spark = forms.sparkSession
    now, number = keep(forms, folder, "roots_0"), 0
    while True:
        further = now.select(F.col("place").alias("root"), F.col("root").alias("next"))
        both = keep(now.join(spread(further), "root", "left"), folder, f"roots_{number + 1}")
        discard(spark, f"{folder}/roots_{number}")
        if both.filter("next is not null").isEmpty():
            return both.select("place", "root")
        now, number = both.select("place", F.coalesce("next", "root").alias("root")), number + 1


def grouped(counts: DataFrame, folder: str, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of counted words."""
    stored = keep(counts, folder, "counts")
    words = numbered(stored, [], [F.col("n").desc(), F.col("word")], folder, "words", total="n_words").select("place", "word", "n")
    named = words.withColumnsRenamed({"place": "best", "word": "form", "n": "form_n"})
    near = keep(nearest(words).join(spread(named), "best"), folder, "near")
    own = words.join(spread(near), "place", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    own = keep(own.withColumn("fits", F.coalesce(fits, F.lit(False))), folder, "forms")
    roots = rooted(own.filter("fits").select("place", F.col("best").alias("root")), folder)
    last = roots.join(spread(words.select(F.col("place").alias("root"), F.col("word").alias("root_word"))), "root").select("place", "root_word")
    return own.join(spread(last), "place", "left").select(
        "word",
        F.when(F.col("fits"), F.col("form")).alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("fits"), F.col("form_n")).alias("form_n"),
    )


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(counted(observed(documents(spark, sf_dir))), shared_dir(spark))
