"""Near-duplicate removal on SimHash groups: one document of each group stays, with all its columns.

A row's key is its id and its text's hash; the least key of a group stays (ids before no id). The text is joined once, to the keys
that stay. Only if one of those belongs to several rows (the same id and text repeated) is a second shuffle needed to keep one of them.

Defined cases: null, empty and blank texts form one group (fingerprint 0, with whatever else links to it); a null id is the last of its group; of
repeated rows (equal id and text) one stays, any of them; ids of any type; texts of any length; an empty table gives an empty result;
columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, shared_dir, unused
from .simhash import fingerprinted, rooted

HASH, ID = "__lexloom_text_hash", "__lexloom_kept_id"


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def kept_keys(docs: DataFrame, folder: str) -> DataFrame:
    """(id, hash, rows) of the document that stays in each group."""
    rows = fingerprinted(docs, F.col("doc_id"), text_hash().alias("hash"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("hash"))
    each = keep(rows, folder, "fingerprints").groupBy("code", key.alias("key")).agg(F.count("*").alias("n"))
    nodes = keep(each.groupBy("code").agg(F.min(F.struct("key", "n")).alias("least")), folder, "nodes")
    discard(docs.sparkSession, f"{folder}/fingerprints")
    roots = rooted(nodes.select("code"), folder).withColumnRenamed("node", "code")
    groups = nodes.join(roots, "code", "left").groupBy(F.coalesce("root", "code").alias("group")).agg(F.min("least").alias("least"))
    return groups.select(F.col("least.key.id").alias(ID), F.col("least.key.hash").alias(HASH), F.col("least.n").alias("n"))


def deduplicated(docs: DataFrame) -> DataFrame:
    folder = shared_dir(docs.sparkSession)
    kept = keep(kept_keys(docs, folder), folder, "kept")
    hashed = unused(docs, "__lexloom_own_hash")
    own = docs.withColumn(hashed, text_hash())
    name, key = unused(own, HASH), unused(own, ID)
    kept = kept.withColumnsRenamed({HASH: name, ID: key})
    out = own.join(kept.drop("n"), (own[hashed] == kept[name]) & own["doc_id"].eqNullSafe(kept[key]), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", hashed])
    return out.select(*(out[f"`{c}`"] for c in docs.columns))
