"""SimHash near-duplicates: fingerprints embedded by segment popcounts, a grid join under Manhattan distance, exact checks.

A fingerprint's 32 segments of two bits map to their bit counts. Flipping one bit moves one count by one, so the Manhattan distance of
two count vectors is at most their fingerprints' Hamming distance. As a thermometer code (00, 01, 11 for 0, 1, 2) the vector is one
64-bit word, and the Manhattan distance is the number of differing bits of two codes.

Grid: the segments lie in b blocks. The range join asks for all pairs of count vectors at Manhattan distance 4 or less. Such a distance
leaves all but 4 blocks without a difference, so the two agree in the counts of some b - 4 blocks; each such choice is a projection of the grid, and
the ranges that a row must look into are its own cells in all of them: C(b, 4) rows instead of the millions of neighbours that a ball of radius 4 has in
32 dimensions. Within a cell rows are compared under the Manhattan bound, then exactly. Copies were merged before (one row for each
distinct fingerprint), and a cell emits stars, at most one edge for each row, never its pairs. More blocks are finer cells and more
copies of a row; b follows from the number of rows, so that evenly spread fingerprints would lie ``CELL_ROWS`` to a cell at most. Every b finds all pairs.

Large cells: a cell of more than ``CHUNK`` fingerprints is handed on in chunks; a second pass compares each pair of chunks
as a task of its own, so none holds more than two chunks, and no pair is left out.

Components of the links are found by alternating stars (``graph``); nothing of it is collected.

Defined cases: null, empty or blank text has fingerprint 0 and links like any other; fewer than four words are one shingle; texts and words of any
length count whole, their hashes in runs of ``HASHES_HELD``; a bit that half of the hashes have is 0; null ids take no part in a component's smallest id
(all null: null); repeated rows repeat; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, each_text, keep, shared_dir
from .graph import components
from .mapped import returned

SHINGLE, SEED, DISTANCE = 4, 42, 4
CHUNK, EDGES_HELD, HASHES_HELD = 8192, 1 << 20, 1 << 16
LEAST_BLOCKS, MOST_BLOCKS, CELL_ROWS = 6, 16, 64
SEGMENTS = 32
LOW_BITS = 0x5555555555555555


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()  # both ASCII only on bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    take = max(1, len(words) - width + 1)
    del words
    starts = np.append(0, ends[: take - 1] + 1)
    stops = ends[len(ends) - take :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, take, HASHES_HELD):
        run = slice(at, at + HASHES_HELD)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[run].tolist(), stops[run].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > take, bitorder="little").view(np.int64)[0])


def fingerprinted(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and ``code``, the fingerprint of ``text`` as a signed number. Texts pass one at a time, and memory goes back between batches."""
    own = docs.select(*columns, F.col("text"))
    schema = own.drop("text").schema.add("code", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array([fingerprint(t) for t in each_text(batch.column(batch.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes], names=schema.names)
            del batch, codes
            returned()

    return own.mapInArrow(run, schema)


def thermometer(code: Column) -> Column:
    odd, even = F.shiftrightunsigned(code, 1).bitwiseAND(F.lit(LOW_BITS)), code.bitwiseAND(F.lit(LOW_BITS))
    return odd.bitwiseOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))


def thermometers(code: np.ndarray) -> np.ndarray:
    low = np.uint64(LOW_BITS)
    odd, even = (code >> np.uint64(1)) & low, code & low
    return odd | even | ((odd & even) << np.uint64(1))


def blocks_for(rows: int, distance: int = DISTANCE) -> int:
    """The least number of blocks with cells enough: a segment's count holds 1.5 bits, so a projection of b - 4 of b blocks tells 2^(48 (b - 4) / b) cells apart."""
    for blocks in range(LEAST_BLOCKS, MOST_BLOCKS):
        if rows <= CELL_ROWS * 2 ** (1.5 * SEGMENTS * (blocks - distance) / blocks):
            return blocks
    return MOST_BLOCKS


def projections(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks (signed) of the projections: every choice of ``blocks - distance`` blocks."""
    edges = [round(i * SEGMENTS / blocks) for i in range(blocks + 1)]
    block = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fold(count: int, pairs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> np.ndarray:
    """Join the rows of each pair: every row gets the smallest row it is connected to."""
    if not pairs:
        return label
    left, right = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    while True:
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            return label
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (deeper := label[label] != label).any():
            label = np.where(deeper, label[label], label)


def stars(group: np.ndarray, code: np.ndarray, side: np.ndarray | None = None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by ``group``: link rows of one group at ``distance`` or less, and give (row, its star's centre) for rows that are not centres.

    Rows are compared at growing offsets, all groups at once. With ``side``, only rows of different sides are.
    """
    count, shape = len(code), thermometers(code)
    label, pairs, held = np.arange(count), [], 0
    left, offset = np.arange(count), 1
    while True:
        left = left[left + offset < count]
        left = left[group[left] == group[left + offset]]
        if not len(left):
            break
        right = left + offset
        near = np.bitwise_count(shape[left] ^ shape[right]) <= distance  # Manhattan distance of the bit counts
        if side is not None:
            near &= side[left] != side[right]
        a, b = left[near], right[near]
        exact = np.bitwise_count(code[a] ^ code[b]) <= distance
        if exact.any():
            pairs.append((a[exact], b[exact]))
            held += int(exact.sum())
            if held > EDGES_HELD:
                label, pairs, held = fold(count, pairs, label), [], 0
        offset += 1
    label = fold(count, pairs, label)
    row = np.flatnonzero(label != np.arange(count))
    return row, label[row]


LINKS = "kind int, a long, b long, cell long"
EDGE, LATER = 0, 1


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges inside cells, from rows sorted by cell; rows of a cell beyond ``CHUNK`` come out as (LATER, code, chunk, cell)."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(cell)], names=["kind", "a", "b", "cell"])

    def edges(cell: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, centre = stars(cell, code)
        if len(row):
            yield out(EDGE, code[row], code[centre], np.zeros(len(row), np.int64))

    def later(cell: np.ndarray, code: np.ndarray, chunk: int) -> pa.RecordBatch:
        return out(LATER, code, np.full(len(code), chunk, np.uint64), cell)

    cell, code, chunk = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    for batch in batches:
        cell = np.append(cell, batch.column(0).to_numpy())
        code = np.append(code, batch.column(1).to_numpy().view(np.uint64))
        while len(cell):
            whole = int(np.searchsorted(cell, cell[-1]))
            first = int(np.searchsorted(cell, cell[0], side="right"))
            if chunk and whole:  # the rest of a cell that was handed on
                yield later(cell[:first], code[:first], chunk)
                yield from edges(cell[:first], code[:first])
                cell, code, chunk = cell[first:], code[first:], 0
            elif whole:
                yield from edges(cell[:whole], code[:whole])
                cell, code = cell[whole:], code[whole:]
            elif len(cell) >= CHUNK:
                yield later(cell[:CHUNK], code[:CHUNK], chunk)
                yield from edges(cell[:CHUNK], code[:CHUNK])
                cell, code, chunk = cell[CHUNK:], code[CHUNK:], chunk + 1
            else:
                break
    if len(cell):
        if chunk:
            yield later(cell, code, chunk)
        yield from edges(cell, code)


def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between two chunks of one cell: rows (task, code, side) sorted by task."""
    task, code, side = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def edges(n: int) -> pa.RecordBatch:
        row, centre = stars(task[:n], code[:n], side[:n])
        return pa.RecordBatch.from_arrays([pa.array(code[row].view(np.int64)), pa.array(code[centre].view(np.int64))], names=["a", "b"])

    for batch in batches:
        task, code, side = np.append(task, batch.column(0).to_numpy()), np.append(code, batch.column(1).to_numpy().view(np.uint64)), np.append(side, batch.column(2).to_numpy())
        whole = int(np.searchsorted(task, task[-1])) if len(task) else 0
        if whole:
            yield edges(whole)
            task, code, side = task[whole:], code[whole:], side[whole:]
    if len(task):
        yield edges(len(task))


def links(codes: DataFrame, folder: str, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints (column ``code`` of a kept table) at ``DISTANCE`` or less."""
    masks = projections(blocks or blocks_for(codes.count()))
    shape = thermometer(F.col("code"))
    cells = F.explode(F.array(*(F.xxhash64(F.lit(i), shape.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks))))
    rows = codes.select(cells.alias("cell"), "code").repartition("cell").sortWithinPartitions("cell")
    found = keep(rows.mapInArrow(linked, LINKS), folder, "links")
    edges = found.filter(F.col("kind") == EDGE).select("a", "b")
    handed = found.filter(F.col("kind") == LATER).select(F.col("cell"), F.col("a").alias("code"), F.col("b").alias("chunk"))
    if handed.isEmpty():
        return edges.distinct()
    chunks = handed.groupBy("cell").agg((F.max("chunk") + 1).alias("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    tasks = handed.join(chunks, "cell").select("cell", "code", "chunk", other).filter("chunk <> other")
    task = F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other"))
    crossing = tasks.select(task.alias("task"), "code", (F.col("chunk") > F.col("other")).cast("int").alias("side")).repartition("task").sortWithinPartitions("task")
    return edges.union(crossing.mapInArrow(crossed, "a long, b long")).distinct()


def rooted(codes: DataFrame, folder: str) -> DataFrame:
    """(node, root) of the fingerprints (a kept table) that are linked to others."""
    found = components(links(codes, folder), folder)
    discard(codes.sparkSession, f"{folder}/links")
    return found


def grouped(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` (doc_id, code) with ``component_id``, the smallest doc_id that links reach."""
    nodes = keep(rows.groupBy("code").agg(F.min("doc_id").alias("least_id")), folder, "nodes")
    roots = rooted(nodes.select("code"), folder).withColumnRenamed("node", "code")
    whole = keep(nodes.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code")), folder, "rooted")
    named = keep(whole.groupBy("root").agg(F.min("least_id").alias("component_id")), folder, "named")  # kept, so that the joins may be split
    of_code = keep(whole.join(named, "root").select("code", "component_id"), folder, "of_code")
    return rows.join(of_code, "code")


def hexadecimal(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    rows = keep(fingerprinted(documents(spark, sf_dir), F.col("doc_id")), folder, "fingerprints")
    return grouped(rows, folder).select("doc_id", hexadecimal(F.col("code")).alias("fingerprint"), "component_id")
