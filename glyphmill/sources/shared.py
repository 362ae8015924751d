"""The checkpoint folder that driver and executors share, small inputs shared among the cores, and Arrow batches cut small."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BATCH_BYTES = 4 << 20
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256

Batches = Iterator[pa.RecordBatch]


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder named in ``spark.checkpoint.dir`` and read again, with its lineage cut.

    Unlike those of a checkpoint, later readers read no more than the columns and row
    groups they need. Where the folder is unset a temporary one is made, but only
    if driver and executors are one machine, as in tests; elsewhere it is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glyphmill-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files are too few or small for them; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_BYTES`` at most, whatever their rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).rstrip("bB")
    if not (held.isdigit() and 0 < int(held) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch) -> Batches:
    """Parts of a batch of about ``SLICE_BYTES`` and at most ``SLICE_ROWS`` rows, in order; a larger row is a part of its own."""
    if batch.num_rows <= SLICE_ROWS and (batch.num_rows <= 1 or batch.nbytes <= SLICE_BYTES):
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with ``run`` over small slices, so that a worker's memory is that of some rows and not of the thousands in a batch."""
    bound_batches(df.sparkSession)

    def bounded(batches: Batches) -> Batches:
        yield from run(part for batch in batches for part in slices(batch))
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.mapInArrow(bounded, schema)
