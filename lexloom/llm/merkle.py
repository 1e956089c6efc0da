"""A Merkle manifest of a dataset: a tree of digests for each group of rows, a root over the groups, and a proof for every row.

Leaves of a group ascend in a given order; every ``ARITY`` consecutive nodes (the last run: fewer, even one) become the digest of their joined hex
digests until one is left, the subroot; subroots in the order of their groups become the root in the same way.

Proofs come by fractal traversal. A group's leaves are dealt into aligned blocks of ``ARITY ** HEIGHT``, each one task's work: for every height the block keeps
the existing subtree (the run of siblings on the way of the current leaf) and the desired one that follows, stacked one over the other. A step
emits a leaf's path from the existing subtrees and pushes one leaf further on into each desired subtree, whose open runs are all it holds; as an existing subtree is
left, the desired one is whole and takes its place. So a block holds its leaves and a few runs for each height, never its tree. Block roots
are a table: levels above them are grouped by Spark, and their proofs, computed top down, are appended to the paths of the blocks below.

A path is an array of steps (digests left of the node, digests right of it), joined as text; ``folded`` and ``proof_digest`` are plain expressions over it.

Defined cases: a null column counts as ``-``; texts of any length count whole; equal ids are ordered by their leaves, null ids come first; repeated rows are leaves of
their own; a group of one leaf has that leaf as subroot and an empty path below it; a null id is never tampered with; an empty table gives an empty
result; columns that aren't named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import discard, documents, keep, shared_dir
from .numbering import numbered, small

ARITY, HEIGHT = 8, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """The UTF-8 byte count, a colon and the value; ``-`` for null."""
    own = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and a path give."""
    return F.aggregate(path, node, lambda own, step: digest(step["left"], own, step["right"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def hashed(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


class Growing:
    """The nodes of one height over leaves that come one by one; holds the open run of each height below."""

    def __init__(self, height: int) -> None:
        self.runs: list[list[str]] = [[] for _ in range(height)]
        self.nodes: list[str] = []

    def push(self, node: str, height: int = 0) -> None:
        for run in self.runs[height:]:
            run.append(node)
            if len(run) < ARITY:
                return
            node = hashed(run)
            run.clear()
        self.nodes.append(node)

    def closed(self) -> list[str]:
        """All nodes, the last ones from shorter runs."""
        for height, run in enumerate(self.runs):
            if run:
                node = hashed(run)
                run.clear()
                self.push(node, height + 1)
        return self.nodes


def grown(leaves: list[str], height: int) -> list[str]:
    out = Growing(height)
    for own in leaves:
        out.push(own)
    return out.closed()


def traversed(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf of a block, in order, up to the block's root; ``height`` levels lie below that."""
    spans = [ARITY ** (i + 1) for i in range(height)]
    existing = [grown(leaves[:span], i) for i, span in enumerate(spans)]
    desired = [Growing(i) for i in range(height)]
    path: list[tuple[str, str]] = [("", "")] * height
    for j in range(len(leaves)):
        width = 1
        for i, span in enumerate(spans):
            if j % span == 0 and j:
                existing[i] = desired[i].closed()
                desired[i] = Growing(i)
            if j % width == 0:
                own, run = j // width % ARITY, existing[i]
                path[i] = "".join(run[:own]), "".join(run[own + 1 :])
            width = span
        yield path
        for span, next_ in zip(spans, desired, strict=True):
            if (ahead := j + span) < len(leaves):
                next_.push(leaves[ahead])


def levels(n: int) -> int:
    """Levels over ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and place, whole blocks: adds each leaf's path in its block, and the block's root beside its first leaf."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        leaves = rows.column("leaf").to_pylist()
        height = min(HEIGHT, levels(rows.column("n")[0].as_py()))
        left, right = [], []
        for path in traversed(leaves, height):
            for a, b in path:
                left.append(a)
                right.append(b)
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        paths = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1) * height, pa.int32()), steps)
        roots = pa.array([*grown(leaves, height), *[None] * (len(leaves) - 1)], pa.string())  # one node
        return rows.append_column("path", paths).append_column("block_root", roots).combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("place").to_numpy() % ARITY**HEIGHT == 0).tolist()
        at = 0
        for start in starts:
            if start > at:
                held.append(batch.slice(at, start - at))
            if held:
                yield done(pa.Table.from_batches(held))
                held = []
            at = start
        held.append(batch.slice(at))
    if held:
        yield done(pa.Table.from_batches(held))


def climbed(nodes: DataFrame, folder: str, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels over ``nodes`` (tree, place, n, node; n: of the tree): for each level the trees that end there (tree, node), and the runs (tree, up, n, run) of the others."""
    tops, runs = [], []
    for level in count():
        nodes = keep(nodes, folder, f"{name}_nodes_{level}")
        tops.append(nodes.filter("n = 1").select("tree", "node"))
        more = nodes.filter("n > 1")
        if more.isEmpty():
            return tops, runs
        up = F.floor(F.col("place") / ARITY).cast("long").alias("up")
        run = F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("run")  # at most ARITY nodes
        runs.append(keep(more.groupBy("tree", up, F.ceil(F.col("n") / ARITY).cast("long").alias("n")).agg(run), folder, f"{name}_runs_{level}"))
        nodes = runs[-1].select("tree", F.col("up").alias("place"), "n", F.sha2(F.array_join("run", ""), 256).alias("node"))
    raise AssertionError


def descended(tops: list[DataFrame], runs: list[DataFrame], over: DataFrame, folder: str, name: str) -> DataFrame:
    """(tree, place, above, ...) of the lowest level: what lies above each node. ``over`` (tree, above, ...): what lies above each tree."""
    out = tops[-1].select("tree", F.lit(0).cast("long").alias("place")).join(over, "tree")
    for level in range(len(runs) - 1, -1, -1):
        at = F.posexplode("run").alias("at", "node")
        parents = out.withColumnRenamed("place", "up")
        each = runs[level].drop("n").join(small(parents), ["tree", "up"]).select("*", at)
        step = F.struct(F.array_join(F.slice("run", 1, F.col("at")), "").alias("left"), F.array_join(F.slice("run", F.col("at") + 2, ARITY), "").alias("right"))
        below = each.withColumn("above", F.concat(F.array(step), "above")).withColumn("place", F.col("up") * ARITY + F.col("at")).drop("up", "at", "node", "run")
        ended = tops[level].select("tree", F.lit(0).cast("long").alias("place")).join(over, "tree")
        out = keep(below.unionByName(ended), folder, f"{name}_above_{level}")
    return out


def proved(rows: DataFrame, order: list[Column], folder: str) -> DataFrame:
    """``rows`` (a stored table with ``tree``, the group's key in the groups' order and without nulls, and ``leaf``) with ``path``, ``subroot`` and ``root``."""
    spark = rows.sparkSession
    placed = numbered(rows, ["tree"], order, folder, "leaves")
    block = F.floor(F.col("place") / ARITY**HEIGHT).cast("long")
    dealt = placed.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "place")
    schema = StructType([*dealt.schema, StructField("path", StructType.fromDDL(f"path {STEPS}")[0].dataType), StructField("block_root", StringType())])
    paths = keep(dealt.mapInArrow(blocks, schema), folder, "paths")
    discard(spark, f"{folder}/leaves_numbered")

    roots = paths.filter(F.col("block_root").isNotNull()).select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / ARITY**HEIGHT).cast("long").alias("n"), F.col("block_root").alias("node"))
    tops, runs = climbed(roots, folder, "group")
    subroots = keep(reduce(DataFrame.unionByName, tops), folder, "subroots")
    ordered = numbered(subroots, [], [F.col("tree")], folder, "subroots").select(F.lit("").alias("tree"), "place", "n", "node", F.col("tree").alias("group"))
    all_tops, all_runs = climbed(ordered.drop("group"), folder, "all")
    root = reduce(DataFrame.unionByName, all_tops).select("tree", F.expr(f"cast(array() as {STEPS})").alias("above"), F.col("node").alias("root"))
    over = descended(all_tops, all_runs, root, folder, "all").join(ordered, ["tree", "place"])
    over = keep(over.select(F.col("group").alias("tree"), "above", "root", F.col("node").alias("subroot")), folder, "over")
    above = descended(tops, runs, over, folder, "group").withColumnRenamed("place", "block")
    both = paths.join(small(above, 4096), ["tree", "block"])
    return both.withColumn("path", F.concat("path", "above")).drop("tree", "block", "place", "n", "block_root", "above")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    columns = {c: F.col(c) for c in COLUMNS}
    tampered = leaf(*(columns | {"text": F.translate("text", UPPER, UPPER.lower())}).values())
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))  # null first, then by bytes
    own = leaf(*columns.values())
    rows = keep(documents(spark, sf_dir).select("doc_id", tree.alias("tree"), own.alias("leaf"), F.when(chosen, tampered).alias("tampered")), folder, "rows")
    found = proved(rows, [F.col("doc_id"), F.col("leaf")], folder)
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
