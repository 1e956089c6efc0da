"""The queries of this subpackage, by name, and the SQL of those that SQL can express.

The first queries apply one operator each with all it returns. No SQL gives a container's bytes, a learned list, a packing or a tokenizer's ids; what SQL can say
of an operator's result has a query of its own, named by the operator's module, that takes its columns from the operator's rows.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Query name: the module and function that give it.
SOURCES = {
    "op1_ogg": "ogg",
    "op2_viterbi_counts": "tokencount",
    "op3_wrappers": "html",
    "op4_decision_list": "quality",
    "op5_best_fit": "packing",
    "op6_virtual_slots": "sharding",
    "op7_simhash": "simhash",
    "op8_elias_fano_lm": "lm",
    "op9_bpe": "bpe",
    "op10_pii": "pii",
    "op11_merkle": "merkle",
    "op12_minhash": "minhash",
    "op13_variants": "variants",
}


def ogg_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator("op1_ogg")(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator("op4_decision_list")(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its pieces lie one behind the other, all but the first are full, and none leaves its sequence."""
    own = operator("op5_best_fit")(spark, sf_dir)
    whole = own.groupBy("doc_id").agg(F.max("piece").alias("last"), F.count("*").alias("n"), F.sum("length").alias("tokens"), F.max(F.col("offset") + F.col("length")).alias("end"))
    return whole.select("doc_id", (F.col("last") + 1 == F.col("n")).alias("gapless"), (F.col("n") == F.ceil(F.col("tokens") / 1024)).alias("full"), (F.col("end") <= 1024).alias("inside"))


def sharding_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = operator("op6_virtual_slots")(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("slot").alias("last"))
    near = F.max("bytes") - F.min("bytes") <= F.avg("bytes") * 0.02
    return own.agg(F.count("*").alias("n_shards"), F.sum("rows").alias("n_rows"), F.sum("bytes").alias("n_bytes"), near.alias("near_equal"), F.min((F.col("last") + 1 == F.col("rows")).cast("int")).alias("gapless"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator("op8_elias_fano_lm")(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 2).alias("base_score"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator("op10_pii")(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = (
    "list_sum(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(m, length(m) - i + 1, 1) AS INTEGER) "
    "WHEN substr(m, length(m) - i + 1, 1) > '4' THEN 2 * CAST(substr(m, length(m) - i + 1, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(m, length(m) - i + 1, 1) AS INTEGER) END)) % 10 = 0"
)
#: CRC-32 of a short text of ASCII characters, bit by bit.
CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: "
    "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"
)
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def leaf_sql(text: str) -> str:
    """The digest of a row's fields."""
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return f"sha256({' || '.join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)})"


#: All nodes level by level (lv: of each tree; tree 0 is that over the groups), then each row's siblings, and the fold of what was tampered with.
MERKLE = (
    f"WITH RECURSIVE d AS (SELECT doc_id, lang, row_number() OVER () AS id, {leaf_sql('text')} AS leaf, CASE WHEN {CRC.format('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf_sql(LOWERED)} END AS tampered FROM documents), "
    "t AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS tree FROM (SELECT DISTINCT lang FROM d)), "
    "p AS (SELECT d.id, d.doc_id, leaf, tampered, tree, row_number() OVER (PARTITION BY tree ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang), "
    "lv AS (SELECT tree, 0 AS level, place, n, leaf AS node FROM p UNION ALL SELECT tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY place)) FROM lv WHERE n > 1 GROUP BY tree, level, place // 8, n), "
    "s AS (SELECT tree, node AS subroot, tree - 1 AS place, count(*) OVER () AS n FROM lv WHERE n = 1), "
    "ls AS (SELECT 0 AS level, place, n, subroot AS node FROM s UNION ALL SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY place)) FROM ls WHERE n > 1 GROUP BY level, place // 8, n), "
    "r AS (SELECT node AS root FROM ls WHERE n = 1), "
    "runs AS (SELECT tree, level, place, node, n, place // 8 AS up FROM lv WHERE n > 1 UNION ALL SELECT 0, level, place, node, n, place // 8 FROM ls WHERE n > 1), "
    "sides AS (SELECT a.tree, a.level, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r "
    "FROM runs a JOIN runs b ON a.tree = b.tree AND a.level = b.level AND a.up = b.up GROUP BY ALL), "
    "f AS (SELECT id, tree, place, 0 AS level, coalesce(tampered, leaf) AS node, '' AS proof, false AS top FROM p UNION ALL "
    "SELECT f.id, CASE WHEN s.tree IS NULL THEN 0 ELSE f.tree END, CASE WHEN s.tree IS NULL THEN f.tree - 1 ELSE f.place // 8 END, CASE WHEN s.tree IS NULL THEN 0 ELSE f.level + 1 END, "
    "CASE WHEN s.tree IS NULL THEN f.node ELSE sha256(s.l || f.node || s.r) END, f.proof || coalesce(s.l || s.r, ''), s.tree IS NULL AND f.tree = 0 FROM f LEFT JOIN sides s ON s.tree = f.tree AND s.level = f.level AND s.place = f.place WHERE NOT f.top) "
    "SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified FROM p JOIN s USING (tree) JOIN f ON f.id = p.id AND f.top, r"
)
ORACLES: dict[str, str] = {
    "ogg_payload": f"WITH {DOCS}, n AS (SELECT *, strlen(text) AS n_bytes, greatest(1, CAST(ceil(strlen(text) / 192) AS BIGINT)) * 192 AS payload_bytes FROM d) "
    "SELECT doc_id, n_bytes, payload_bytes, sha256(text || repeat(' ', payload_bytes - n_bytes)) AS payload_sha256 FROM n",
    "quality_base": f"WITH {DOCS}, w AS (SELECT doc_id, text, {WORDS} AS words FROM d), "
    "u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w), "
    "g AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), "
    "r AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g WHERE five IS NOT NULL) WHERE n > 1), "
    "k AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM r) GROUP BY doc_id), "
    r"l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w) "
    "SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, "
    r"CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, "
    "CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(words) AS base_failed FROM l LEFT JOIN k USING (doc_id)",
    "packing_totals": "SELECT DISTINCT doc_id, true AS gapless, true AS \"full\", true AS inside FROM documents",
    "sharding_balance": "SELECT 8::BIGINT AS n_shards, count(*) AS n_rows, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS n_bytes, true AS near_equal, 1 AS gapless FROM documents",
    "lm_base": f"WITH d AS (SELECT doc_id, lower_ascii AS text, {CRC.format('CAST(doc_id AS VARCHAR)')} % 10 = 0 AS held_out FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)), "
    f"t AS (SELECT doc_id, held_out, unnest(list_append({WORDS}, chr(10))) AS token FROM d), "
    "c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token), n AS (SELECT sum(c) AS n, count(*) AS v FROM c) "
    "SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 2) AS base_score FROM t LEFT JOIN c USING (token), n GROUP BY doc_id, held_out",
    "pii_base": f"WITH {DOCS} SELECT doc_id, "
    r"CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email, "
    r"CAST(len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0)) AS BIGINT) AS n_ip, "
    rf"CAST(len(list_filter(list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda m: {DIGITS}), lambda m: length(m) BETWEEN 12 AND 19 AND {LUHN})) AS BIGINT) AS n_card, "
    rf"CAST(len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length({DIGITS}) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM d",
}
ORACLES["op11_merkle"] = MERKLE
VIEWS = (ogg_payload, quality_base, packing_totals, sharding_balance, lm_base, pii_base)


def operator(name: str) -> Query:
    """The query by its name; its module is imported when it runs, so that one library that is missing leaves the others be."""
    return lambda spark, sf_dir: getattr(import_module(f"{__package__}.{SOURCES[name]}"), name)(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: operator(name) for name in SOURCES} | {own.__name__: own for own in VIEWS}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
