"""Files in and out: text and binary sources, base64 at the edges, and exports of what was verified."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.sources import folders

BINARY_LIMIT = 32 * 1024 * 1024
# Extensions of text files that are taken.
TEXT_EXTENSIONS = ("txt", "md", "markdown", "html", "htm", "csv", "json", "xml", "yaml", "yml")


def _files(spark: SparkSession, path: str | list[str], recursive: bool, limit: int, too_large: str, empty: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, bytes, content, error_code) of the files below each path.

    Stores that only Spark opens are read by its own file source, which passes over files of no byte.
    """
    parts = []
    for one in [path] if isinstance(path, str) else path:
        try:
            folders.opened(one)
        except (pa.ArrowInvalid, OSError):
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(one)
            name = F.element_at(F.split("path", "/"), -1)
            listed = listed.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*extensions)) if extensions else listed
            own = lambda fits, content, error: listed.where(fits).select("path", name.alias("name"), F.col("length").alias("bytes"), content.alias("content"), F.lit(error).cast("string").alias("error_code"))  # noqa: B023, E731
            small = F.col("length") <= limit
            parts.append(own(small, F.col("content"), None).unionByName(own(~small, F.lit(None).cast("binary"), too_large)))
        else:
            parts.append(folders.read(spark, one, limit=limit, tooLarge=too_large, empty=empty, recursive=recursive, extensions=",".join(extensions)))
    return reduce(DataFrame.unionByName, parts)


def read_texts(spark: SparkSession, path: str | list[str], limit: int = tx.TEXT_LIMIT, recursive: bool = True) -> DataFrame:
    """(path, name, bytes, text, error_code): whole files with a text extension, as plain text.

    Bytes that are no UTF-8 become U+FFFD; a byte order mark stays and counts as a
    mark. Empty files are empty texts. Files beyond ``limit`` are not opened: null text, ``text-too-large``.
    """
    found = _files(spark, path, recursive, limit, "text-too-large", "", TEXT_EXTENSIONS)
    return found.select("path", "name", "bytes", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "error_code")


def read_binaries(spark: SparkSession, path: str | list[str], limit: int = BINARY_LIMIT, recursive: bool = True) -> DataFrame:
    """(path, name, bytes, content, error_code): whole files; empty ones and those beyond ``limit`` are ``size-limit`` rows and not opened."""
    return _files(spark, path, recursive, limit, "size-limit", "size-limit")


def from_base64(payloads: DataFrame, column: str, limit: int = BINARY_LIMIT) -> DataFrame:
    """``payloads`` with ``content`` and ``error_code``: bad base64, no byte, or more than ``limit`` bytes."""
    longest = (limit + 2) // 3 * 4
    decoded = F.when(F.length(column) <= longest, F.try_to_binary(F.col(column), F.lit("base64")))
    out = payloads.withColumn("content", decoded)
    size = F.octet_length("content")
    error = F.when(F.col(column).isNull(), None).when(F.length(column) > longest, "size-limit").when(F.col("content").isNull(), "bad-base64").when(~size.between(1, limit), "size-limit")
    return out.withColumn("error_code", error).withColumn("content", F.when(F.col("error_code").isNull(), F.col("content")))


def to_base64(files: DataFrame, column: str = "output") -> DataFrame:
    """``files`` with ``<column>_base64``, in one line whatever the session chunks."""
    return files.withColumn(f"{column}_base64", F.replace(F.base64(column), F.lit("\r\n"), F.lit("")))


def export_texts(sanitized: DataFrame, path: str, name_col: str = "name") -> None:
    """Sanitized texts as Parquet (export_name, output), only those whose verification passed."""
    sanitized.where("verification_passed").select(tx.export_name(F.col(name_col)).alias("export_name"), "output").write.parquet(path)


def export_binaries(cleaned: DataFrame, path: str, name_col: str = "name") -> None:
    """Cleaned files as Parquet (export_name, output), only those whose verification passed."""
    cleaned.where("verification_passed").select(tx.clean_file_name(F.col(name_col), F.col("format")).alias("export_name"), "output").write.parquet(path)


def save_texts(sanitized: DataFrame, path: str, name_col: str = "name", mode: str = "append") -> None:
    """Sanitized texts as files ``<name>.sanitized.txt`` of UTF-8, only those whose verification passed (see ``folders.write``)."""
    passed = sanitized.where("verification_passed")
    folders.write(passed.select(tx.export_name(F.col(name_col)).alias("export_name"), "output"), path, "export_name", "output", mode)


def save_binaries(cleaned: DataFrame, path: str, name_col: str = "name", mode: str = "append") -> None:
    """Cleaned files as files ``<name>.clean.<format>``, only those whose verification passed (see ``folders.write``)."""
    passed = cleaned.where("verification_passed")
    folders.write(passed.select(tx.clean_file_name(F.col(name_col), F.col("format")).alias("export_name"), "output"), path, "export_name", "output", mode)
