"""What the operators of this subpackage share: the shared folder, tables kept in it, Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at a time inside one Arrow batch; bounds a worker's memory, changes no result.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine (tests) a temporary folder is set; on a cluster that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lexloom.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("lexloom.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lexloom/{uuid.uuid4().hex}"


def keep(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, nothing is computed twice,
    and a lost executor costs only a reread."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a kept table that nothing needs any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def each_text(values: pa.Array) -> Iterator[bytes]:
    """The values of a string column as UTF-8, one at a time, null as empty; no list of them is made."""
    import numpy as np

    _, ends, data = values.buffers()
    if not len(values) or data is None:
        yield from (b"" for _ in range(len(values)))
        return
    wide = pa.types.is_large_string(values.type)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    there = values.is_valid().to_pylist() if values.null_count else None
    view = memoryview(data)
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        yield bytes(view[a:b]) if there is None or there[i] else b""


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``most`` bytes; a longer row is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    values = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [v or b"" for v in values.cast(pa.binary() if pa.types.is_string(values.type) else pa.large_binary()).to_pylist()]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` with per-task state: ``make`` runs once in each task and gives the function for bounded runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch, column):
                yield each(part)

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A vocabulary file in ``folder``, else in ``LEXLOOM_TOKENIZERS``, else of the installed public_tokenizers package."""
    folder = folder or os.environ.get("LEXLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
