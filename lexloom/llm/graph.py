"""Connected components of an edge table by alternating stars, with each round written to the shared folder.

Defined cases: self-loops and repeated edges count nothing; a node without an edge to another isn't in the result; an edge with a null end is left
out; an empty table gives an empty result. Ends are integers of any type.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep

SALTS = 64


def with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least v of their u.

    A centre may have a third of all edges. Minima are taken for each (u, salt of v) first, and each u's minimum goes back to
    the salts that it has, so that neither the sums nor the join put a centre's edges into one task.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))  # at most SALTS rows of a u
    return salted.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).drop("salt")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the component's smallest node.

    A large-star step links each node's larger neighbours to the smallest of its neighbourhood, a small-star step its smaller ones; both
    keep components, and together they end in one star for each component after a number of rounds that is logarithmic in the
    edges. A round's table replaces the one before.
    """
    spark = edges.sparkSession
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, "edges_0")
    before = None
    for number in count(1):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = with_least(now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v"))
        large = both.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = with_least(large)
        small = low.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        now = keep(small.distinct(), folder, f"edges_{number}")
        discard(spark, f"{folder}/edges_{number - 1}")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root"), F.col("root"))).distinct()
