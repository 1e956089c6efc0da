"""Bulk-synchronous best-fit packing of token sequences.

The state is one table of unplaced documents (pieces) and open gaps (sequences with room), each with its size, a whole number up to the capacity.
Pieces longer than half the capacity open a sequence each. Then supersteps repeat until no piece is left. In each, documents and gaps
are range-sorted by size: a row's global rank is the number of rows in lower (size, bucket) cells, which the driver holds (at most capacity x
buckets numbers of each kind), plus its place in its cell, so no task gets a size that a third of all rows share. One of two moves follows.

* Sweep: in ascending order of size (documents before gaps of their size) every gap takes the largest document before it that no smaller
  gap took. That is the matching of brackets, documents opening and gaps closing; a row's depth follows from its rank and the number of
  rows of the other kind below its size, brackets of one depth alternate, so a shuffle by depth puts every pair side by side. A depth has at
  most one document and one gap of each size. Conflicts are thereby settled by rank: of documents that want one gap the largest gets it.
* Deal: where documents outnumber the gaps that hold two or more of the longest document, ranks are dealt to these gaps, largest
  documents first, as many to each as fit whatever their length.

Gaps then shrink by what they took, and the next superstep sorts them anew. Before a superstep, documents longer than
every gap open as many sequences as their tokens fill. Nothing but the histogram comes to the driver.

Supersteps: one sweep places at most one document in a gap, a deal as many as surely fit; real lengths take about ten in all. The sequences are those of
best-fit decreasing but for some hundredths of a per cent (see the tests); lengths that all lie closely above a third of the capacity cost 3 %.

Ids come from tiktoken with the same vocabulary (tests hold it to the tokenizers library); texts of ``LONG_TEXT`` characters or more, where its regular
expression may exhaust its stack on one run of white space, are encoded by ``bpe`` instead, with the same ids.

Defined cases: a null or empty text is one piece, the end token; longer documents are cut, all pieces but the first full; texts of any length are
read whole; equal lengths are told apart by the pieces' numbers; repeated rows and null ids are pieces of their own; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, keep, map_batches, shared_dir, texts, tokenizer_file

CAPACITY, END = 1024, 2
LONG_TEXT = 500_000
#: Rows a bucket of one size aims at, and bounds on the number of buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 64, 256
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer(name: str, folder: str | None = None):
    """The vocabulary for tiktoken, which gives the ids of the tokenizers library in a quarter of its time."""
    import tiktoken

    from .bpe import shown_bytes

    with open(tokenizer_file(name, folder), encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = shown_bytes()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): number for token, number in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding(name, pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens=added)


_TOKENIZERS: dict[str, object] = {}


def pieces(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document."""

    def make():
        if name not in _TOKENIZERS:
            _TOKENIZERS[name] = tokenizer(name, folder)
        encoding = _TOKENIZERS[name]

        def ids_of(text: bytes) -> list[int]:
            if len(text) >= LONG_TEXT:
                from .bpe import encoder

                return encoder(tokenizer_file(name, folder)).encode([text])[0]
            return encoding.encode(text.decode("utf-8", "replace"), allowed_special="all", disallowed_special=())

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                ids = np.array([*ids_of(text), END], "<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    out.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return each

    return map_batches(docs.select("doc_id", "text"), make, PIECES)


class Histogram:
    """How many rows of one kind each (size, bucket) holds."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells
        self.sizes = cells.sum(axis=1)
        self.total = int(self.sizes.sum())
        used = np.flatnonzero(self.sizes)
        self.least, self.most = (int(used[0]), int(used[-1])) if len(used) else (0, 0)

    @staticmethod
    def of(size: np.ndarray, bucket: np.ndarray, n: np.ndarray, capacity: int, buckets: int) -> Histogram:
        cells = np.zeros((capacity + 1, buckets), np.int64)
        cells[size, bucket] = n
        return Histogram(cells)

    def ranked(self, others: np.ndarray) -> list[np.ndarray]:
        """Size, bucket, rows before in ascending order, and the size's entry of ``others``, of each cell in use."""
        size, bucket = np.nonzero(self.cells)
        before = np.cumsum(self.cells) - self.cells.ravel()
        return [size, bucket, before.reshape(self.cells.shape)[size, bucket], others[size]]

    def opened(self, first: int, count: int) -> Histogram:
        """With ``count`` empty sequences more, numbered -1 - first and on downward."""
        cells = self.cells.copy()
        buckets = cells.shape[1]
        rest = (-1 - np.arange(buckets)) % buckets  # -1 - k falls into the bucket where k is this modulo the buckets
        cells[-1] += (first + count - rest + buckets - 1) // buckets - (first - rest + buckets - 1) // buckets
        return Histogram(cells)


def bucket_of(item: Column, buckets: int) -> Column:
    return F.pmod(item, F.lit(buckets)).cast("int")


def fresh(docs: Histogram, gaps: Histogram, capacity: int) -> int:
    """How many sequences to open: as many as the documents that are longer than every gap fill."""
    lengths = np.arange(capacity + 1)
    return int(-(-(lengths * docs.sizes)[gaps.most + 1 :].sum() // capacity))


def dealing(docs: Histogram, gaps: Histogram) -> tuple[int, int]:
    """(gaps, documents to each) of a deal; no gaps where a sweep is better."""
    longest = docs.most
    wide = np.cumsum(gaps.sizes[::-1])[::-1]  # gaps with at least so much room
    if 2 * longest >= len(wide) or not 0 < wide[2 * longest] < docs.total:
        return 0, 0
    chosen = max(((int(wide[n * longest]), n) for n in range(2, gaps.most // longest + 1)), key=lambda c: (min(c[0] * c[1], docs.total), -c[1]))
    return chosen[0], min(chosen[1], -(-docs.total // chosen[0]))


def ranks(state: DataFrame, docs: Histogram, gaps: Histogram, buckets: int) -> DataFrame:
    """``state`` with each row's ascending rank among its kind, and the number of rows of the other kind below it in a sweep."""
    smaller, not_larger = np.cumsum(gaps.sizes) - gaps.sizes, np.cumsum(docs.sizes)
    own, open_ = docs.ranked(smaller), gaps.ranked(not_larger)
    columns = [np.repeat([False, True], [len(own[0]), len(open_[0])]), *(np.append(a, b) for a, b in zip(own, open_, strict=True))]
    kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gap", "size", "bucket", "before", "others"])
    cells = state.sparkSession.createDataFrame(table)  # at most 2 x capacity x buckets rows
    cell = Window.partitionBy("gap", "size", "bucket").orderBy("item")
    own = state.withColumn("bucket", bucket_of(F.col("item"), buckets)).withColumn("within", F.row_number().over(cell) - 1)
    return own.join(F.broadcast(cells), ["gap", "size", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))


def swept(ranked: DataFrame, capacity: int) -> DataFrame:
    """Every gap takes the largest document before it that no smaller gap took."""
    depth = F.when(F.col("gap"), F.col("others") - F.col("rank")).otherwise(F.col("rank") + 1 - F.col("others"))
    side = Window.partitionBy("depth").orderBy("size", "gap")
    rows = ranked.withColumn("depth", depth)
    other = F.struct("gap", "item", "size")
    rows = rows.withColumn("next", F.lead(other).over(side)).withColumn("last", F.lag(other).over(side))
    taken, gave = ~F.col("gap") & F.coalesce(F.col("next.gap"), F.lit(False)), F.col("gap") & ~F.coalesce(F.col("last.gap"), F.lit(True))
    return rows.withColumns({
        "sequence_id": F.when(taken, F.col("next.item")),
        "offset": F.when(taken, (F.lit(capacity) - F.col("next.size")).cast("long")),
        "size": F.col("size") - F.when(gave, F.col("last.size")).otherwise(0),
    })


def dealt(ranked: DataFrame, docs: Histogram, gaps: Histogram, width: int, each: int, capacity: int) -> DataFrame:
    """The largest documents go to the ``width`` widest gaps, ``each`` to one at most."""
    place = F.when(F.col("gap"), gaps.total - 1 - F.col("rank")).otherwise(docs.total - 1 - F.col("rank"))
    inside = F.when(F.col("gap"), F.col("place") < width).otherwise(F.col("place") < width * each)
    alone = -1 - F.col("place") - F.when(F.col("gap"), docs.total).otherwise(0)  # no other row has this
    rows = ranked.withColumn("place", place).withColumn("in", inside)
    rows = rows.withColumn("gap_no", F.when(F.col("in"), F.col("place") % width).otherwise(alone))
    own = Window.partitionBy("gap_no")
    turn = own.orderBy(F.desc("gap"), "place")
    length = F.when(F.col("gap"), 0).otherwise(F.col("size"))
    rows = rows.withColumn("first", F.first(F.struct("item", "size")).over(turn)).withColumn("before", F.sum(length).over(turn) - length).withColumn("whole", F.sum(length).over(own))
    placed = F.col("in") & ~F.col("gap")
    return rows.withColumns({
        "sequence_id": F.when(placed, F.col("first.item")),
        "offset": F.when(placed, (F.lit(capacity) - F.col("first.size") + F.col("before")).cast("long")),
        "size": F.when(F.col("gap") & F.col("in"), F.col("size") - F.col("whole")).otherwise(F.col("size")).cast("int"),
    })


STATE = ("gap", "item", "size", "doc_id", "piece", "start", "ids_crc32", "sequence_id", "offset")


def packed(rows: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (a kept table: ``PIECES`` and ``item``, a number of each row's own) with ``sequence_id`` and ``offset``."""
    spark = rows.sparkSession
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS))
    large = F.col("length") * 2 > capacity
    nothing, no = F.lit(None), F.lit(None).cast("long")
    done = [rows.filter(large).withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("long"))]
    own = rows.withColumn("sequence_id", no).withColumn("offset", no).withColumnRenamed("length", "size")
    opened_gap = [F.lit(True).alias("gap"), F.col("item"), (F.lit(capacity) - F.col("size")).cast("int").alias("size"), no.alias("doc_id"), nothing.cast("int").alias("piece"), no.alias("start"), no.alias("ids_crc32"), no.alias("sequence_id"), no.alias("offset")]
    big = F.col("size") * 2 > capacity
    state = own.filter(~big).withColumn("gap", F.lit(False)).select(*STATE).union(own.filter(big & (F.col("size") < capacity)).select(*opened_gap))
    opened, step = 0, 0
    while True:
        counted = state.groupBy("gap", "size", bucket_of(F.col("item"), buckets).alias("bucket")).agg(F.count("*").alias("n")).toArrow()  # at most 2 x capacity x buckets rows
        gap, *cells = (counted[c].to_numpy() for c in ("gap", "size", "bucket", "n"))
        docs = Histogram.of(*(c[~gap] for c in cells), capacity, buckets)
        if not docs.total:
            break
        state = state.filter(~F.col("gap") | (F.col("size") >= docs.least))  # what no document fits is full
        fits = gap & (cells[0] >= docs.least)
        gaps = Histogram.of(*(c[fits] for c in cells), capacity, buckets)
        if count := fresh(docs, gaps, capacity):
            new = spark.range(opened, opened + count).select((-1 - F.col("id")).alias("item"), F.lit(0).alias("size"))
            state = state.union(new.select(*opened_gap))
            gaps = gaps.opened(opened, count)
            opened += count
        ranked = ranks(state, docs, gaps, buckets)
        width, each = dealing(docs, gaps)
        moved = dealt(ranked, docs, gaps, width, each, capacity) if width else swept(ranked, capacity)
        after = keep(moved.select(*STATE), folder, f"superstep_{step}")
        step += 1
        done.append(after.filter("not gap and sequence_id is not null").withColumnRenamed("size", "length"))
        state = after.filter("gap or sequence_id is null")
    out = done[0].select(*PLACED)
    for part in done[1:]:
        out = out.union(part.select(*PLACED))
    return out


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document with its place."""
    shared = shared_dir(docs.sparkSession)
    rows = keep(pieces(docs, name, folder, capacity).withColumn("item", F.monotonically_increasing_id()), shared, "pieces")
    return packed(rows, shared, capacity).withColumn("length", F.col("length").cast("long"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
