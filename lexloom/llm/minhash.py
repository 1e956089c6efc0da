"""MinHash near-duplicates: one-permutation sketches with optimal densification, banded buckets, star-shaped candidates, exact checks.

A document's set holds its distinct 2-word shingles as 64-bit hashes. One permutation of the hashes deals them into ``BINS`` bins by their top bits; the
least of a bin is its value, and an empty bin takes the value of the first filled bin on a sequence of its own (optimal densification: a hash of the bin and
the attempt). ``PERMUTATIONS`` such sketches, independent of each other, are cut into bands of ``ROWS`` values, each with the band's number hashed to a bucket. Sets at a similarity
of 0.8 share at least one of the 96 buckets but for a chance of about 2e-8 (sets of 20: 3e-4, as a permutation shows them only in their few filled bins).

Equal sets are one node. Candidates are stars: the least node of each bucket is its centre, and the others meet it alone. A node's most promising centre (most buckets in
common) is checked first, and what is confirmed forms components; further centres count only where they are of another component. So copies cost about one pair a node.

Links between two nodes that are no centre may still be missing. They lie in buckets that hold several components beside the centre, which has met all the others; their nodes but for the centre are searched
to the end by the prefix rule: with shingles in the order of their rarity among these nodes, similar sets share one of the first n - ceil(0.8 n) + 1. Shingles that at most ``RARE`` nodes have give their pairs at once. Two
sets that share none of those in their prefixes need frequent ones there, and near misses have few, as rare shingles of their own fill their prefixes; for the others frequent
shingles are buckets again, of which the next centres are taken in each round, ``MORE`` times as many as before, as long as a bucket holds several
components. Sizes, places and counts that rule the similarity out are dropped before any set is read; so the rounds are few, and no pair is left out.

Checks are on full sets: pairs come together by centre, in parts of about ``PART`` pairs, each with the centre's set once.

Defined cases: a null, empty or blank text has an empty set and is a component of its own; one word is a set of that word; repeated words and rows count once;
texts of any length count whole; null ids take no part in a component's least id (all null: null, and such a row is kept); an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import discard, documents, each_text, keep, shared_dir, slices
from .graph import components
from .mapped import returned
from .numbering import numbered, sieved

SHINGLE, PERCENT = 2, 80
PERMUTATIONS, BINS, ROWS = 3, 256, 8
BANDS = PERMUTATIONS * BINS // ROWS
PART, MORE, WAVE, RARE = 256, 16, 8, 128


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))
EDGES = (np.arange(BINS, dtype=object) * (1 << 64) // BINS).astype(np.uint64)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.lower().split()  # both ASCII only on bytes
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words))], np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(digest, joined), np.uint64, len(words) - width + 1))


def attempts(seed: np.uint64, at: int, many: int = 64) -> np.ndarray:
    """For each bin, the bins that it tries from attempt ``at`` on."""
    number = np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32) | np.arange(at, at + many, dtype=np.uint64)
    return (mixed(number ^ seed) % np.uint64(BINS)).astype(np.int64)


FIRST = [attempts(seed, 0) for seed in SEEDS]


def sketch(own: np.ndarray, number: int) -> np.ndarray:
    """The values of all bins under permutation ``number``; ``own`` isn't empty."""
    dealt = np.sort(mixed(own ^ SEEDS[number]))
    starts = np.searchsorted(dealt, EDGES)
    filled = np.append(starts[1:], len(dealt)) > starts
    source = np.arange(BINS)
    empty, at = np.flatnonzero(~filled), 0
    while len(empty):
        tried = (FIRST[number] if not at else attempts(SEEDS[number], at))[empty]
        there = filled[tried]
        found = there.any(axis=1)
        source[empty[found]] = tried[found, there[found].argmax(axis=1)]
        empty, at = empty[~found], at + 64
    return dealt[starts[source]]


def buckets(own: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    values = np.concatenate([sketch(own, p) for p in range(PERMUTATIONS)]).reshape(BANDS, ROWS)
    out = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 << 32))
    for column in values.T:
        out = mixed(out ^ column) + column
    return mixed(out)


def sketched(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, the set's size, its ``key`` (null where it's empty) and its buckets. Texts pass one at a time, and memory goes back between batches."""
    own = docs.select(*columns, F.col("text"))
    schema = own.drop("text").schema.add("n_shingles", "long").add("key", "long").add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in each_text(batch.column(batch.num_columns - 1)):
                own = shingles(text)
                sizes.append(len(own))
                keys.append(xxhash.xxh64_intdigest(own.tobytes()) if len(own) else None)
                if len(own):
                    bands.append(buckets(own))
            size = np.array(sizes, np.int64)
            key = pa.array(np.array([k or 0 for k in keys], np.uint64).view(np.int64), mask=size == 0)
            ends = np.append(0, np.cumsum((size > 0) * BANDS)).astype(np.int32)
            flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size), key, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=schema.names)
            del batch
            returned()

    return own.mapInArrow(run, schema)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def hashed(texts: DataFrame) -> DataFrame:
    """(key, hashes): the sets of texts (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = [shingles(text).view(np.int64) for text in each_text(part.column(1))]
                ends = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], names=["key", "hashes"])
            del batch
            returned()

    return texts.select("key", "text").mapInArrow(run, "key long, hashes array<long>")


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (centre, part, key, hashes), a part's centre first: the pairs whose full sets are similar."""
    task, centre = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, part, b = (batch.column(i).to_pylist() for i in range(3))
        lists = batch.column(3)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        found: tuple[list[int], list[int]] = [], []
        for i in range(batch.num_rows):
            own = flat[at[i] : at[i + 1]]
            if b[i] is None:
                task, centre = (a[i], part[i]), own.copy()
            elif task == (a[i], part[i]) and similar(centre, own):
                found[0].append(a[i])
                found[1].append(b[i])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b; a stored table) whose sets are similar. A frequent centre's pairs are dealt over parts."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    others = dealt.join(sets.withColumnRenamed("key", "b"), "b").select("a", "part", "b", "hashes")
    none = F.lit(None).cast("long").alias("b")
    centres = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("key", "a"), "a").select("a", "part", none, "hashes")
    both = centres.union(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return both.mapInArrow(confirmed, "a long, b long")


def fit(a: str = "n", b: str = "other_n", percent: int = PERCENT) -> Column:
    """Sizes that allow the similarity."""
    return (F.col(a) * percent <= F.col(b) * 100) & (F.col(b) * percent <= F.col(a) * 100)


def links(nodes: DataFrame, texts_of, folder: str, spent: str | None = None) -> DataFrame | None:
    """(node, root) of the nodes that links reach; None without any. ``nodes``: a stored table of key, n and bands; ``texts_of``: the texts of keys; ``spent``: the table's
    name, if it may go once its buckets have been read."""
    spark = nodes.sparkSession
    sizes = keep(nodes.select("key", "n"), folder, "sizes")
    rows = nodes.select(F.explode("bands").alias("bucket"), "key").repartition("bucket")  # once, for the counts and for the members
    shared = rows.groupBy("bucket").agg(F.min("key").alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    members = keep(rows.join(shared, "bucket"), folder, "members")
    if spent:
        discard(spark, f"{folder}/{spent}")
    sets = keep(hashed(texts_of(members.select("key").distinct())), folder, "sets")
    pairs = members.filter(F.col("least") < F.col("key")).groupBy(F.col("least").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("shared"))
    other = sizes.select(F.col("key").alias("a"), F.col("n").alias("other_n"))
    pairs = pairs.join(sizes.withColumnRenamed("key", "b"), "b").join(other, "a").filter(fit()).select("a", "b", "shared")
    roots, tried = waves(keep(pairs, folder, "pairs"), sets, None, folder, "stars")
    others = members.filter((F.col("key") != F.col("least")) & (F.col("rows") > 2)).select("bucket", "key")  # a centre has met all of its bucket; one other is no two components
    open_ = keep(mixed_buckets(with_root(others, "key", roots, "root")).select("key").distinct().join(sizes, "key"), folder, "open")
    discard(spark, f"{folder}/members")
    if open_.isEmpty():
        return roots
    found = prefixes(open_, sets, folder)
    few = found.filter(F.col("often") <= RARE).withColumn("core", F.size("core"))
    pairs = keep(rare_pairs(with_root(few, "key", roots, "root")), folder, "rare")
    pairs = pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs
    roots, more = waves(keep(pairs, folder, "rare_pairs"), sets, roots, folder, "rare")
    tried = more if tried is None else tried if more is None else tried.union(more)
    members = numbered(found.filter(F.col("often") > RARE), ["bucket"], [F.col("key")], folder, "frequent", total="rows")
    first, strip = 0, 1
    for number in count():
        left = members.filter((F.col("place") >= first) & (F.col("rows") > first + 1))  # without the centres that have had their turn
        own = keep(with_root(left, "key", roots, "root"), folder, f"rooted_{number}")
        if number:
            discard(spark, f"{folder}/rooted_{number - 1}")
        centres = keep(mixed_buckets(own, F.col("place") < first + strip), folder, f"centres_{number}")
        if centres.isEmpty():
            return roots
        pairs = met(own, centres)
        pairs = pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs
        pairs = keep(pairs, folder, f"pairs_{number}")
        found = keep(checked(pairs, sets), folder, f"links_{number}")
        if not found.isEmpty():
            roots = joined(found, roots, folder, str(number))
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        first, strip = first + strip, strip * MORE
    raise AssertionError


def mixed_buckets(rooted: DataFrame, which: Column | None = None) -> DataFrame:
    """The rows, or those of ``which``, of buckets that hold several components."""
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    return (rooted if which is None else rooted.filter(which)).join(several, "bucket", "left_semi")


def waves(pairs: DataFrame, sets: DataFrame, roots: DataFrame | None, folder: str, name: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Check all of ``pairs`` (a, b, shared; a stored table) that components don't make needless: a node's most promising pair first, then ``WAVE`` times as many each time.
    Gives the roots after that, and the pairs that were checked."""
    tried = None
    for wave in count():
        turn = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "a"))
        chosen = keep(pairs.withColumn("turn", turn).filter(F.col("turn") <= WAVE**wave).select("a", "b"), folder, f"{name}_chosen_{wave}")
        if chosen.isEmpty():
            return roots, tried
        tried = chosen if tried is None else tried.union(chosen)
        found = keep(checked(chosen, sets), folder, f"{name}_links_{wave}")
        if not found.isEmpty():
            roots = joined(found, roots, folder, f"{name}_{wave}")
        pairs = keep(across(pairs.join(chosen, ["a", "b"], "left_anti"), roots), folder, f"{name}_left_{wave}")
    raise AssertionError


def least_prefix(n: Column, percent: int = PERCENT) -> Column:
    """So many of a set's rarest shingles hold one that any similar set has among its own."""
    return n - F.ceil(n * percent / 100) + 1


def prefixes(open_: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """(bucket, key, n, at, often, last, core) of open nodes (key, n): their rarest shingles, as many as ``least_prefix``, with their place in the order of rarity, the number of open nodes that
    have them, the prefix's length, and those of the prefix that more than ``RARE`` open nodes have, shortened to 32 bits (equal ones stay equal).

    Of two similar sets the rarest common shingle is in both prefixes. Shingles that only one open node has find nobody; they just take the first places.
    """
    each = sets.join(open_, "key", "left_semi").select(F.explode("hashes").alias("bucket"), "key")
    often = each.groupBy("bucket").agg(F.count("*").alias("often")).filter("often > 1")
    found = keep(each.join(often, "bucket"), folder, "common")
    totals = found.groupBy("key").agg(F.count("*").alias("many")).join(open_, "key")
    turn = F.row_number().over(Window.partitionBy("key").orderBy("often", "bucket"))
    placed = found.withColumn("turn", turn).join(totals, "key").withColumn("at", F.col("n") - F.col("many") + F.col("turn")).withColumn("last", least_prefix(F.col("n")))
    placed = keep(placed.filter(F.col("at") <= F.col("last")).select("bucket", "key", "n", "at", "often", "last"), folder, "placed")
    core = placed.groupBy("key").agg(F.collect_list(F.when(F.col("often") > RARE, F.shiftright("bucket", 32).cast("int"))).alias("core"))  # a prefix at most
    return keep(placed.join(core, "key"), folder, "prefixes")


def enough(common: Column, percent: int = PERCENT) -> Column:
    """Whether two sets can be similar with so many common shingles of their prefixes: what else they share follows the prefix that ends first."""
    both = common + F.greatest(F.col("n") - F.col("last"), F.col("other_n") - F.col("other_last"))
    return both * (100 + percent) >= percent * (F.col("n") + F.col("other_n"))


def reach(percent: int = PERCENT) -> Column:
    """Whether two sets whose prefixes share the shingle at ``at`` and ``other_at`` can be similar: what precedes and what follows bounds their common part."""
    both = F.least("at", "other_at") + F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at"))
    return both * (100 + percent) >= percent * (F.col("n") + F.col("other_n"))


def as_centre(rows: DataFrame) -> DataFrame:
    names = {"key": "a", "root": "a_root", "n": "other_n", "at": "other_at", "last": "other_last", "core": "other_core"}
    return rows.select("bucket", *(F.col(own).alias(other) for own, other in names.items()))


def rare_pairs(own: DataFrame) -> DataFrame:
    """The pairs across components that share shingles of their prefixes which at most ``RARE`` open nodes have, if those and the frequent ones can make them similar."""
    both = own.join(as_centre(own), "bucket").filter((F.col("a") < F.col("key")) & (F.col("root") != F.col("a_root")) & fit() & reach())
    other = ["n", "other_n", "last", "other_last", "core", "other_core"]
    pairs = both.groupBy("a", F.col("key").alias("b"), *other).agg(F.count("*").alias("shared"))
    return pairs.filter(enough(F.col("shared") + F.least("core", "other_core"))).select("a", "b", "shared")


def with_root(rows: DataFrame, node: str, roots: DataFrame | None, into: str) -> DataFrame:
    """``rows`` with the root of their node, itself where no link reaches it."""
    if roots is None:
        return rows.withColumn(into, F.col(node))
    return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(into)), node, "left").withColumn(into, F.coalesce(into, node))


def across(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Those of ``pairs`` (a, b, shared) whose ends are in different components."""
    both = with_root(with_root(pairs, "a", roots, "a_root"), "b", roots, "b_root")
    return both.filter("a_root <> b_root").select("a", "b", "shared")


def joined(found: DataFrame, roots: DataFrame | None, folder: str, name: str) -> DataFrame:
    """(node, root) after the links ``found`` (a, b), of which only those across components count."""
    spark = found.sparkSession
    if roots is None:
        new = components(found, f"{folder}/round_{name}")
        return keep(new, folder, f"roots_{name}")
    both = with_root(with_root(found, "a", roots, "a_root"), "b", roots, "b_root").filter("a_root <> b_root")
    merged = keep(components(both.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), f"{folder}/round_{name}"), folder, f"merged_{name}")
    discard(spark, f"{folder}/round_{name}")
    moved = with_root(roots, "root", merged, "new").select("node", F.col("new").alias("root"))
    fresh = merged.join(roots.select("node"), "node", "left_anti")
    return keep(moved.union(fresh), folder, f"roots_{name}")


def met(own: DataFrame, centres: DataFrame) -> DataFrame:
    """The pairs across components of ``centres`` and the members of their buckets that follow them. Pairs that the frequent shingles of their prefixes alone can't make similar share a
    rare one, so they were found by it."""
    common = F.array_intersect("core", "other_core")
    meets = F.get(common, F.lit(0)) == F.shiftright("bucket", 32).cast("int")  # in one of its buckets, that of the first common shingle
    twice = [F.size(c) - F.size(F.array_distinct(c)) for c in ("core", "other_core")]  # shortened ones that fell together
    possible = fit() & reach() & meets & enough(F.size(common) + twice[0] + twice[1])
    both = own.join(as_centre(centres), "bucket").filter((F.col("a") < F.col("key")) & (F.col("root") != F.col("a_root")) & possible)
    return both.select("a", F.col("key").alias("b"), F.size(common).alias("shared")).distinct()


def named(doc_id: Column) -> Column:
    """An id as text, null as nothing."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def grouped(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows. Buckets are the bulk of what is kept, so the tables that hold them go when they have been read."""
    spark = docs.sparkSession
    sketches = keep(sketched(docs, F.col("doc_id"), text_hash().alias("hash")), folder, "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("row")
    each = sketches.filter("key is not null").groupBy("key").agg(least, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    banded = keep(each.withColumn("node", F.monotonically_increasing_id()), folder, "banded")  # neighbours' numbers differ in few bytes, so shuffles are smaller than with keys
    nodes = keep(banded.drop("bands"), folder, "nodes")
    rows = keep(sketches.select("doc_id", "n_shingles", "key"), folder, "rows")
    discard(spark, f"{folder}/sketches")

    def texts_of(keys: DataFrame) -> DataFrame:
        """The text of each node, that of its least row; copies of that row are one."""
        wanted = keep(nodes.join(keys.withColumnRenamed("key", "node"), "node", "left_semi").select("node", named(F.col("row.doc_id")).alias("id"), F.col("row.hash").alias("hash")), folder, "wanted")
        own = docs.select(named(F.col("doc_id")).alias("id"), text_hash().alias("hash"), "text")
        both = sieved(own, wanted, ["id", "hash"]).join(wanted, ["id", "hash"]).groupBy("id", "hash").agg(F.first("node").alias("key"), F.first("text").alias("text"))
        return both.select("key", "text")

    roots = links(banded.select(F.col("node").alias("key"), "n", "bands"), texts_of, folder, "banded")
    ids = nodes.select("key", "node", F.col("row.doc_id").alias("id"))
    whole = ids.withColumn("root", F.col("node")) if roots is None else ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = keep(whole, folder, "rooted")
    least_ids = keep(whole.groupBy("root").agg(F.min("id").alias("component_id")), folder, "least_ids")
    of_key = keep(whole.join(least_ids, "root").select("key", "component_id"), folder, "of_key")
    own = rows.filter("key is not null").select("doc_id", "n_shingles", "key").join(of_key, "key").drop("key")
    return own.union(rows.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir), shared_dir(spark)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
