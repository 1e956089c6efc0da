"""Places in a total order, found on all machines: rows are range-sorted, numbered in their parts, and the sizes of the parts before are added.

Defined cases: ties are broken by the row's number in the stored table, so every row has a place of its own and a key that a third of all rows share
spreads over the parts; nulls come first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep

#: Rows that a counted side may have to be broadcast.
SMALL = 20_000


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """``rows`` to be broadcast if there are ``most`` at most, which is counted; else as they are, for Spark to choose a join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


#: Bits of a sieve for each row that it has to let pass, of a block of it (what Spark's bitmaps hold), and at most.
SIEVE_EACH, SIEVE_BLOCK, SIEVE_MOST = 16, 1 << 15, 1 << 28


def sieved(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` without most of those that have no equal in ``wanted`` (a stored table) in the columns ``by``, so that few of them are shuffled for a join with it.

    Every task gets a bitmap of ``SIEVE_EACH`` bits a wanted row, at most ``SIEVE_MOST`` (32 MB; beyond it more others pass). No row that has an equal is left out, and about one in
    seventeen of the others passes, so the join has to follow.
    """
    blocks = min(SIEVE_MOST, max(1, wanted.count()) * SIEVE_EACH) // SIEVE_BLOCK + 1
    bit = F.pmod(F.xxhash64(*by), F.lit(blocks * SIEVE_BLOCK))
    block, spot = F.floor(bit / SIEVE_BLOCK).alias("__block"), F.pmod(bit, F.lit(SIEVE_BLOCK)).alias("__spot")
    sieve = wanted.select(block, spot).repartition("__block").groupBy("__block").agg(F.bitmap_construct_agg("__spot").alias("__bits"))
    byte = F.conv(F.hex(F.substr("__bits", (F.shiftright("__spot", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    both = rows.select("*", block, spot).join(F.broadcast(sieve), "__block")
    return both.filter(F.getbit(byte, F.pmod("__spot", F.lit(8)).cast("int")) == 1).select(*rows.columns)


def numbered(rows: DataFrame, by: list[str], order: list[Column], folder: str, name: str, into: str = "place", total: str = "n") -> DataFrame:
    """``rows`` (a stored table) with their place from 0 in ``order`` among those equal in the columns ``by`` (without nulls), and the number of those.

    Sizes come to one row for each part and each value of ``by`` in it; a value's parts are as many as its rows fill.
    """
    spark = rows.sparkSession
    keys = [*(F.col(c) for c in by), *order, F.col("__row")]
    own = rows.withColumn("__row", F.monotonically_increasing_id())
    at = F.monotonically_increasing_id()
    sorted_ = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row").withColumn("__at", at)
    sorted_ = keep(sorted_.withColumn("__part", F.shiftright("__at", 33)), folder, f"{name}_sorted")
    sizes = sorted_.groupBy("__part", *by).agg(F.count("*").alias("__size"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = keep(
        sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).withColumn(total, F.sum("__size").over(whole)).drop("__size", "__first"),
        folder, f"{name}_starts",
    )
    out = keep(sorted_.join(small(starts), ["__part", *by]).withColumn(into, F.col("__at") + F.col("__before")).drop("__at", "__part", "__before"), folder, f"{name}_numbered")
    for done in ("sorted", "starts"):
        discard(spark, f"{folder}/{name}_{done}")
    return out
