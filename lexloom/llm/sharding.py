"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots. Bytes and rows are summed per slot and part of a slot (at most ``n_slots`` x ``PARTS``
rows, whatever the input), and a versioned table maps slots to shards. Where a map folder holds a version, the next one is an edit of the last:
new shards start empty, a shard that is gone gives up its slots, and as few slots as even out the bytes are moved or swapped. Without one,
version 1 deals slots round robin and version 2 is its edit. Every version stays readable in the folder.

Rows meet the map through a broadcast join whose small side has ``n_slots`` x ``PARTS`` rows by construction. A place in a shard is the number
of rows in lower (slot, part) cells of the shard plus the row's number in its cell; parts split a slot's rows by their number in the stored
table. A slot follows from id, checksum and the number of equal records, so that no id and no text that a third of all rows share is heavy. DataFrame operations only.

Defined cases: a null text counts no bytes (size 1, crc32 of nothing, 0); a null id is an id of its own; texts of any length count whole; repeated rows and equal ids are kept, each with a place of its own, in the order of their
numbers; an empty table gives an empty result and a map of empty slots; other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, keep, shared_dir
from .numbering import small

N_SLOTS, PARTS = 4096, 16
MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of each record, and its ``row`` in the input; the text goes no further than this projection."""
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long")
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("row"))


def slotted(records: DataFrame, folder: str, n_slots: int = N_SLOTS) -> DataFrame:
    """``records`` (a stored table) with their virtual slot: a hash of the id, the checksum and the number of the record among those equal in both.

    So an id, or a text, that a third of all rows share lies in all slots. Equal records are numbered within the partitions of the input, and the
    partitions' counts are added up; of most records there is one, and its number is 0.
    """
    equal = ["id", "text_crc32"]
    own = records.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("from", F.shiftright("row", 33))
    counts = own.groupBy(*equal, "from").agg(F.count("*").alias("rows"))
    whole, before = Window.partitionBy(*equal), Window.partitionBy(*equal).orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*equal, "from", F.sum("rows").over(whole).alias("all"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    starts = keep(starts.filter("all > 1").drop("all"), folder, "starts")
    one = own.join(small(starts.select(*equal).distinct()), equal, "left_anti").withColumn("number", F.lit(0).cast("long"))
    turn = F.row_number().over(Window.partitionBy(*equal, "from").orderBy("row"))
    more = own.join(small(starts), [*equal, "from"]).withColumn("number", F.col("start") + turn - 1).drop("start")
    slot = F.pmod(F.xxhash64("id", "text_crc32", "number"), F.lit(n_slots)).cast("int")
    return one.unionByName(more).withColumn("vslot", slot).select("doc_id", "size", "text_crc32", "vslot", "row")


def rebalanced(sizes: list[int], shard_of: list[int], n_shards: int, tolerance: float = 1e-4) -> list[int]:
    """Edit a slot-to-shard map until shard bytes differ by less than ``tolerance`` of their mean, or no edit helps.

    Each step takes the heaviest and the lightest shard and makes the one move or swap that comes closest to halving their
    difference. It works on ``len(sizes)`` integers only.
    """
    out = list(shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    load = [0] * n_shards
    for slot, (size, shard) in enumerate(zip(sizes, out, strict=True)):
        held[shard].append((size, slot))
        load[shard] += size
    for own in held:
        own.sort()
    enough = tolerance * sum(sizes) / max(1, n_shards)
    for _ in range(20 * len(sizes)):
        order = sorted(range(n_shards), key=lambda s: (load[s], s))
        changed = False
        for light, heavy in ((a, b) for b in reversed(order) for a in order if load[a] < load[b]):
            gap = load[heavy] - load[light]
            if gap <= max(enough, 1):
                continue
            best: tuple[int, tuple[int, int] | None, tuple[int, int] | None] = (gap, None, None)
            for give in [(0, -1), *held[light]]:
                at = bisect_left(held[heavy], (give[0] + gap // 2, -1))
                for take in held[heavy][max(0, at - 1) : at + 1]:
                    left = abs(gap - 2 * (take[0] - give[0]))
                    if left < best[0]:
                        best = (left, take, give)
            if best[1] is not None:
                for item, here, there in ((best[1], heavy, light), (best[2], light, heavy)):
                    if item[1] >= 0:
                        held[here].remove(item)
                        insort(held[there], item)
                        load[here] -= item[0]
                        load[there] += item[0]
                        out[item[1]] = there
                changed = True
                break
        if not changed:
            break
    return out


def latest(spark: SparkSession, folder: str) -> tuple[int, list[int]] | None:
    """The last stored version of a map and its shard of each slot; None if the folder has none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/slot_map")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    table = spark.read.parquet(f"{folder}/slot_map")
    version = table.agg(F.max("version")).first()[0]
    return version, [r.shard for r in table.filter(F.col("version") == version).orderBy("vslot").collect()]  # n_slots rows


def housed(shard_of: list[int], n_shards: int) -> list[int]:
    """The map with slots of shards that are gone dealt to those that stay."""
    return [shard if shard < n_shards else slot % n_shards for slot, shard in enumerate(shard_of)]


def slot_map(spark: SparkSession, sizes: list[int], n_shards: int, folder: str) -> tuple[int, list[int]]:
    """Store the next version of the folder's map, edited for these bytes of the slots; give its number and the shard of each slot."""
    before = latest(spark, folder)
    first = [slot % n_shards for slot in range(len(sizes))]
    new = [(1, first)] if before is None else []
    version, last = before or (1, first)
    new.append((version + 1, rebalanced(sizes, housed(last, n_shards), n_shards)))
    for number, shard_of in new:
        rows = [(number, slot, shard, size) for slot, (shard, size) in enumerate(zip(shard_of, sizes, strict=True))]
        spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/slot_map")
    return new[-1]


def assign(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The records with ``shard`` and their gapless place in it, and all versions of the stored map. ``map_folder``: where earlier versions are."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    stored = keep(sized(docs), folder, "sizes")
    records = keep(slotted(stored, folder, n_slots).withColumn("part", F.pmod("row", F.lit(PARTS)).cast("int")), folder, "records")
    usage = records.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("vslot", "part").toArrow()  # at most n_slots x PARTS rows
    slot, part, size, count = (usage[c].to_pylist() for c in ("vslot", "part", "bytes", "rows"))
    sizes = [0] * n_slots
    for s, own in zip(slot, size, strict=True):
        sizes[s] += own
    version, shard_of = slot_map(spark, sizes, n_shards, map_folder or folder)
    filled = [0] * n_shards
    base = []
    for s, n in zip(slot, count, strict=True):
        base.append(filled[shard_of[s]])
        filled[shard_of[s]] += n
    columns = {"vslot": pa.array(slot, pa.int32()), "part": pa.array(part, pa.int32()), "shard": pa.array([shard_of[s] for s in slot], pa.int32()), "base": pa.array(base, pa.int64())}
    table = spark.createDataFrame(pa.table(columns))
    order = Window.partitionBy("vslot", "part").orderBy("row")
    placed = records.withColumn("rank", F.row_number().over(order)).join(F.broadcast(table), ["vslot", "part"])
    return placed.withColumn("slot", (F.col("base") + F.col("rank") - 1).cast("long")).drop("row", "part", "rank", "base"), spark.read.schema(MAP_SCHEMA).parquet(f"{map_folder or folder}/slot_map")


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = assign(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
