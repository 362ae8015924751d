"""Batches of files: which are admitted, how a stream of files is cut into them, and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_FILES = 50
MOST_BYTES = 128 * 1024 * 1024
MOST_FILE_BYTES = 32 * 1024 * 1024


def admit(files: DataFrame, batch_col: str, size_col: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_file_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """(batch, n_files, n_bytes, admitted): a batch is admitted whole or not at all.

    Partial sums are made where the files are; a batch of any size is one row.
    """
    size = F.col(size_col)
    within = (F.col("n_files") <= most_files) & (F.col("n_bytes") <= most_bytes) & (F.col("_least") >= 1) & (F.col("_most") <= most_file_bytes)
    return (
        files.groupBy(batch_col).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"), F.min(size).alias("_least"), F.max(size).alias("_most"))
        .select(batch_col, "n_files", "n_bytes", F.coalesce(within, F.lit(False)).alias("admitted"))
    )


def cut(
    files: DataFrame, stream_col: str, id_col: str, size_col: str, lanes: int = 64, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES
) -> DataFrame:
    """``files`` with ``lane`` and ``batch_no``: files in the order of their whole-number ids, cut by running count and size.

    A stream is dealt into ``lanes`` lanes by id, so that one with a third of all
    files is not one task's work; batches lie within a lane. A lane falls into a
    grid of ``most_files`` files by half of ``most_bytes``, and a batch is a run of
    files in one cell: it exceeds neither limit unless one file alone is larger
    than half of ``most_bytes``.
    """
    dealt = files.withColumn("lane", F.pmod(F.col(id_col), F.lit(lanes)).cast("long"))
    so_far = Window.partitionBy(stream_col, "lane").orderBy(id_col)
    count = F.floor((F.row_number().over(so_far) - 1) / most_files)
    volume = F.floor(F.sum(size_col).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.lit(max(1, most_bytes // 2)))
    cells = dealt.withColumn("_count", count).withColumn("_volume", volume)
    turn = F.dense_rank().over(Window.partitionBy(stream_col, "lane").orderBy("_count", "_volume"))
    return cells.withColumn("batch_no", turn.cast("long")).drop("_count", "_volume")


def rollup(reports: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Sums of ``counts`` and number of rows for every prefix of ``keys``; totals have null keys."""
    return reports.rollup(*keys).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in counts])
