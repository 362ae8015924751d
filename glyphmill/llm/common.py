"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 2 << 20
SLICE_ROWS = 2_048
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset a temporary one is made, but only if driver and executors
    are one machine (``local``, as in tests); elsewhere it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = temporary()
    return folder


@lru_cache(maxsize=1)
def temporary() -> str:
    return tempfile.mkdtemp(prefix="glyphmill-")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the session has, or else to ``shared_folder``, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Tables made within each scratch that is open, the innermost last.
OPEN: list[list[Tables]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Clears at its end, be it by an error, all tables that operators made within it: for results that are stored elsewhere by then."""
    OPEN.append([])
    try:
        yield
    finally:
        for tables in OPEN.pop():
            tables.clear()


class Tables:
    """Parquet tables in a folder of their own below ``shared_folder``.

    A table that is written and read again has no lineage, and unlike a
    checkpoint none of the optimizer's constraints on what it was made from, which
    multiply in long loops. ``clear`` removes the folder once nothing is read from it;
    the end of a ``scratch`` does so for all that was made within it, but those that are ``kept``.
    """

    def __init__(self, spark: SparkSession, kept: bool = False) -> None:
        self.spark = spark
        if OPEN and not kept:
            OPEN[-1].append(self)
        self.folder = f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.n = 0
        self.names: list[str] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again; its columns may have any names."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
        plain.write.parquet(path)
        return self.spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)

    def bucketed(self, df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        """``df`` as a table in buckets of ``keys``: joins and groups by them do not shuffle it again.

        The catalog needs a name for it until ``clear``; its files are in the folder.
        """
        self.n += 1
        name = f"t{uuid.uuid4().hex}"
        even = df.repartition(buckets, *keys)
        even.write.bucketBy(buckets, *keys).option("path", f"{self.folder}/{self.n}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def clear(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut, and later readers read the columns they need."""
    return Tables(df.sparkSession).cut(df)


def position(df: DataFrame, name: str) -> int:
    """Index of the column called ``name``: an exact match wins over one that differs in case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    loose = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not loose:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return loose[0]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: ``pick(df, text="body")``.

    Works by position, so that other columns may repeat a name or differ from it in case.
    """
    at = {new: position(df, old) for new, old in columns.items()}
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").alias(new) for new, i in at.items()])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_BYTES`` and at most ``SLICE_ROWS`` rows, in order; a larger row is a part of its own."""
    if batch.num_rows <= SLICE_ROWS and (batch.num_rows <= 1 or batch.nbytes <= SLICE_BYTES):
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches cut small on both sides of the pipe, so that long texts do not add up in memory.

    The session's Arrow batches are held to ``BATCH_BYTES`` at most (a smaller setting stays);
    a task gives memory back when it ends, as its worker goes on to other tasks.
    """
    conf = df.sparkSession.conf
    held = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if not (held.isdigit() and 0 < int(held) <= BATCH_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(part for batch in batches for part in slices(batch))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def append(
    df: DataFrame,
    inputs: Sequence[str],
    make: Callable[[], Callable[..., list[pa.Array]]],
    fields: Sequence[StructField],
) -> DataFrame:
    """``df`` with computed columns behind its own; an own column of the same name gives way.

    ``make()`` runs once in each task and returns the function that turns the
    input columns of a slice of an Arrow batch into the arrays of ``fields``. No shuffle.
    """
    taken = {f.name.lower() for f in fields}
    use = [position(df, c) for c in inputs]
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in taken]
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    own = flat.schema.fields
    schema = StructType([own[i] for i in keep] + [StructField(f"_new{j}", f.dataType) for j, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            arrays = [batch.column(i) for i in keep] + work(*[batch.column(i) for i in use])
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    names = [df.columns[i] for i in keep] + [f.name for f in fields]
    return map_batches(flat, run, schema).toDF(*names)


def texts_of(array: pa.Array) -> list[str]:
    """The strings of an Arrow column; null is the empty text."""
    return [t or "" for t in array.to_pylist()]


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(folds)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows outside the held-out fold.

    ``most`` is the bound of the sample: it makes the id list small enough to
    broadcast at every size of the corpus. Rows are taken in the order of a
    hash of the id; a document labelled more than once takes its largest label,
    and of documents that share an id the one of least text counts, so that the
    bound holds for rows too.
    """
    marks = pick(labels, doc_id=id_col, label=label).where(F.col("label").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(marks), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
