"""Exact vector search that leaves most vectors unread: clusters, rings in them, and bounds by the triangle inequality of angles.

Vectors go to the centre of the least angle. Angles on the sphere are a metric, so a question at the angle q of a centre is at least max(q - high, low - q, 0) away from any
vector whose angle to that centre lies in [low, high]. A cluster's vectors are sorted by their angle and cut into rings of ``RING``; a large cluster just
has more rings. For each ring its centre and the two angles are kept.

A block of questions meets the rings' bounds first, in Arrow batches whose matrices stay in the task: each question's ``SEEDS`` best rings are read, their k-th best cosine is a
threshold, and then only rings whose bound reaches it. A task hands on each question's k best of a batch, never its pairs. The result is that of comparing every question
with every vector.

Centres are ``centres`` vectors drawn from a bounded sample (``SAMPLE`` rows) with ``ROUNDS`` rounds of Lloyd's algorithm; they decide how much is left unread, never what is found.

Defined cases: a null or zero vector has cosine 0 with everything and lies in rings of its own; vectors of other lengths count as filled up with zeros; ties go
to the lesser id; repeated rows count each; a question without a vector has cosine 0 with all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .bm25 import ranked
from .lineage import discarded, kept, new_folder, small

RING, SEEDS, SAMPLE, ROUNDS, LEAST_CENTRES, MOST_CENTRES = 64, 2, 16_384, 8, 4, 1024
MOST_QUESTIONS = 256
EPS = 1e-7


def matrix(values: pa.Array, wide: int) -> np.ndarray:
    """Unit rows of a list column, filled up with zeros to ``wide``; null and zero vectors are zero rows."""
    out = np.zeros((len(values), wide))
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(pc.list_flatten(values), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(lengths) - lengths
    norm = np.zeros(len(values))
    for length in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == length)
        part = flat[at[own][:, None] + np.arange(length)]
        norm[own] = np.sqrt((part * part).sum(axis=1))
        out[own, : min(length, wide)] = part[:, :wide]
    return np.divide(out, norm[:, None], out=np.zeros_like(out), where=norm[:, None] > 0)


def units(rows: list[Row], wide: int) -> np.ndarray:
    return matrix(pa.array([r[0] for r in rows], pa.list_(pa.float64())), wide)


def fitted(sample: np.ndarray, many: int, seed: int = 7) -> np.ndarray:
    """Unit centres of a sample."""
    rnd = np.random.default_rng(seed)
    sample = sample[np.abs(sample).sum(axis=1) > 0]
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[rnd.choice(len(sample), min(many, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, np.divide(sums, size, out=np.zeros_like(sums), where=size > 0), centres)
    return centres


@dataclass(frozen=True)
class Clusters:
    """An index below one folder: ``members`` (id, vector, cluster, angle, ring) and ``rings`` (cluster, ring, low, high, n); centres as rows of a matrix."""

    spark: SparkSession
    folder: str
    centres: np.ndarray

    @property
    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/members")

    @property
    def rings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rings")

    def drop(self) -> None:
        discarded(self.spark, self.folder)


def build(vectors: DataFrame, id_column: str, vector: str, folder: str | None = None, centres: int | None = None) -> Clusters:
    """Index all rows. ``centres``: by default the root of their number, between ``LEAST_CENTRES`` and ``MOST_CENTRES``."""
    spark = vectors.sparkSession
    folder = folder or new_folder(spark)
    own = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    count, wide = own.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    share = min(1.0, SAMPLE / max(1, count))
    sample = own.filter("vector is not null").select("vector").sample(share, seed=7).limit(SAMPLE).collect()
    found = fitted(units(sample, max(1, wide)), centres or min(MOST_CENTRES, max(LEAST_CENTRES, int(count**0.5))))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = matrix(batch.column("vector"), found.shape[1])
            near = unit @ found.T
            cluster = near.argmax(axis=1)
            zero = np.abs(unit).sum(axis=1) == 0
            angle = np.where(zero, 0.0, np.arccos(np.clip(near[np.arange(len(unit)), cluster], -1, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(zero, -1, cluster).astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cluster", "angle"])

    placed = kept(own.mapInArrow(assigned, "id bigint, vector array<double>, cluster int, angle double"), f"{folder}/placed")  # ranges are sampled from it
    sorted_ = placed.repartitionByRange("cluster", "angle", "id").sortWithinPartitions("cluster", "angle", "id")
    at = F.monotonically_increasing_id()
    members = kept(sorted_.withColumn("ring", F.shiftright(at, RING.bit_length() - 1)), f"{folder}/members")
    discarded(spark, f"{folder}/placed")
    members.groupBy("cluster", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).write.parquet(f"{folder}/rings")
    return Clusters(spark, folder, found)


@dataclass(frozen=True)
class Found:
    """``hits``: query_id, id, score, rank. ``report``: query_id, vectors, vectors_read, rings, rings_read."""

    hits: DataFrame
    report: DataFrame


def bounds(rings: DataFrame, clusters: Clusters, questions: np.ndarray, least: np.ndarray | None, slack: float = EPS) -> DataFrame:
    """(cluster, ring, n, number, bound): each question's (``number``) rings of the highest bounds, at most ``SEEDS`` of each batch; or with ``least`` those that reach it."""
    angles = np.arccos(np.clip(clusters.centres @ questions.T, -1, 1))
    blank = np.abs(questions).sum(axis=1) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, low, high = (batch.column(c).to_numpy() for c in ("cluster", "low", "high"))
            q = angles[np.maximum(cluster, 0)]
            away = np.maximum(np.maximum(q - high[:, None], low[:, None] - q), 0)
            bound = np.where((cluster == -1)[:, None] | blank[None, :], 0.0, np.cos(np.minimum(away, np.pi))) + slack
            if least is not None:
                row, number = np.nonzero(bound >= least[None, :])
            else:
                order = np.argsort(-bound, axis=0, kind="stable")[:SEEDS]
                row, number = order.ravel(), np.broadcast_to(np.arange(bound.shape[1]), order.shape).ravel()
            taken = [batch.column(c).take(pa.array(row)) for c in ("cluster", "ring", "n")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(number.astype(np.int32)), pa.array(bound[row, number])], names=["cluster", "ring", "n", "number", "bound"])

    return rings.mapInArrow(run, "cluster int, ring bigint, n bigint, number int, bound double")


def nearest(members: DataFrame, chosen: DataFrame, questions: np.ndarray, k: int, digits: int | None) -> DataFrame:
    """(number, id, score): the k best of each question in its chosen rings (cluster, ring, number) of each batch."""
    wanted = chosen.groupBy("cluster", "ring").agg(F.sort_array(F.collect_set("number")).alias("numbers"))  # a block of questions at most
    rows = members.select("id", "vector", "cluster", "ring").join(small(wanted), ["cluster", "ring"]).select("id", "vector", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = matrix(batch.column("vector"), questions.shape[1]) @ questions.T
            score = score if digits is None else np.round(score, digits)
            wanted = np.zeros(score.shape, bool)
            lists = batch.column("numbers")
            wanted[np.repeat(np.arange(len(score)), pc.list_value_length(lists).to_numpy()), pc.list_flatten(lists).to_numpy()] = True
            ids = batch.column("id").to_numpy()
            out: tuple[list, list, list] = [], [], []
            for number in np.flatnonzero(wanted.any(axis=0)):
                own = np.flatnonzero(wanted[:, number])
                best = own[np.lexsort((ids[own], -score[own, number]))[:k]]
                out[0].append(np.full(len(best), number, np.int32))
                out[1].append(ids[best])
                out[2].append(score[best, number])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["number", "id", "score"])

    return rows.mapInArrow(run, "number int, id bigint, score double")


def search(clusters: Clusters, questions: DataFrame, k: int, digits: int | None = None, folder: str | None = None) -> Found:
    """The k best vectors of each question (query_id, query_vector). Questions come in blocks of about ``MOST_QUESTIONS``; tables are kept below ``folder``."""
    spark = clusters.spark
    folder = folder or new_folder(spark)
    own = questions.select("query_id", F.col("query_vector").cast("array<double>").alias("vector"))
    number = max(1, -(-own.count() // MOST_QUESTIONS))
    part = F.pmod(F.xxhash64("query_id"), F.lit(number))
    hits, report = None, None
    members, rings = clusters.members, clusters.rings
    whole = rings.agg(F.sum("n").alias("vectors"), F.count("*").alias("rings"))
    for at in range(number):
        rows = own.filter(part == at).orderBy("query_id").collect()
        for start in range(0, len(rows), MOST_QUESTIONS):
            asked = rows[start : start + MOST_QUESTIONS]
            place = f"{folder}/{at}_{start}"
            block = matrix(pa.array([r.vector for r in asked], pa.list_(pa.float64())), clusters.centres.shape[1])
            names = spark.createDataFrame(pa.table({"number": pa.array(range(len(asked)), pa.int32()), "query_id": pa.array([r.query_id for r in asked], pa.int64())}))
            slack = EPS if digits is None else EPS + 10.0**-digits
            seeds = kept(ranked(bounds(rings, clusters, block, None), SEEDS, ["number"], "cluster", "ring", score="bound"), f"{place}_seeds")
            first = kept(nearest(members, seeds, block, k, digits), f"{place}_first")
            kth = ranked(first, k, ["number"], "id").filter(F.col("rank") == k).select("number", "score").collect()  # a row a question
            least = np.full(len(asked), -2.0)
            for r in kth:
                least[r.number] = r.score
            open_ = kept(bounds(rings, clusters, block, least, slack), f"{place}_open")
            rest = nearest(members, open_.join(seeds.select("cluster", "ring", "number"), ["cluster", "ring", "number"], "left_anti"), block, k, digits)
            found = ranked(first.unionByName(rest), k, ["number"], "id").join(F.broadcast(names), "number").select("query_id", "id", "score", "rank")
            read = open_.select("number", "cluster", "ring", "n").unionByName(seeds.select("number", "cluster", "ring", "n")).distinct().groupBy("number").agg(F.sum("n").alias("vectors_read"), F.count("*").alias("rings_read"))
            told = read.join(F.broadcast(names), "number").crossJoin(F.broadcast(whole)).select("query_id", "vectors", "vectors_read", "rings", "rings_read")
            hits, report = (found, told) if hits is None else (hits.unionByName(found), report.unionByName(told))
    if hits is None:
        hits = spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
        report = spark.createDataFrame([], "query_id bigint, vectors bigint, vectors_read bigint, rings bigint, rings_read bigint")
    return Found(hits, report)
