"""Cutting lineage by checkpoints and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and read back from the checkpoint folder: a short plan for what follows, and nothing is lost with an executor.

    The folder is the session's ``spark.checkpoint.dir``; only where none is set and all runs on one machine (tests) a temporary one is.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(rows.sparkSession))
    return rows.checkpoint()


def shared_root(spark) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``, or a temporary one on a single machine."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or "file://" + tempfile.mkdtemp(prefix="lexloom-")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_root(spark).rstrip('/')}/lexloom/{uuid.uuid4().hex}"


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that all machines have mounted, None for any other store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def kept(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written as Parquet and read back: computed once, with filters and column choice still reaching the scan."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def discarded(spark: SparkSession, path: str) -> None:
    """Delete a kept table that nothing needs any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows that a side of a join may have to be broadcast.
SMALL = 100_000


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """``rows`` to be broadcast if they are ``most`` at most, which is counted; else as they are, for Spark to choose a join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def in_order(rows: DataFrame, *order: str | Column, into: str = "place") -> DataFrame:
    """``rows`` with their number from 1 in a total order: a row's number in its part of the sorted rows, and the sizes of the parts before."""
    own = settled(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    own = own.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = own.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a partition
    return own.join(F.broadcast(before), "__part").withColumn(into, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")
