"""Whole files as a data source: read by listed size, and written one file a row.

``read`` lists a folder first, so files that are empty, too large or of another
extension are rows with an error, or no rows, without being opened; the others are
dealt out by their bytes. Filters on path, name, bytes and error_code reach the list.

``write`` gives each row a file. A task writes to a folder of its own attempt; committing
the job moves the folders of the attempts that count to their places, one rename for each
task, and takes away all others. So a task that is tried again, or a job that
fails, leaves no file behind, half or whole.

Paths are what ``pyarrow.fs`` opens (a local or mounted folder, hdfs, s3, gs).
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringEndsWith, StringStartsWith, WriterCommitMessage

NAME = "whole_files"
READ_SCHEMA = "path string, name string, bytes long, content binary, error_code string"
PARTITION_BYTES = 64 << 20
PARTITION_FILES = 1_000
BATCH_BYTES = 8 << 20
UNSAFE = re.compile(r"[^\w.\- ]")
STAGING = "_staging-"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return pafs.LocalFileSystem(), path


@dataclass
class Listed(InputPartition):
    """Files of one task: (path, size, error) each."""

    files: list[tuple[str, int, str | None]]

    def __init__(self, files: list[tuple[str, int, str | None]]) -> None:
        super().__init__(0)
        self.files = files


def admits(f: Filter, row: dict) -> bool | None:
    """Whether a listed file passes a filter; None where the list cannot tell."""
    if isinstance(f, Not):
        inner = admits(f.child, row)
        return None if inner is None or (row.get(getattr(f.child, "attribute", ("",))[0]) is None and not isinstance(f.child, (IsNull, IsNotNull))) else not inner
    if len(f.attribute) != 1 or f.attribute[0] not in row:
        return None
    own = row[f.attribute[0]]
    if isinstance(f, (IsNull, IsNotNull)):
        return (own is None) == isinstance(f, IsNull)
    if isinstance(f, In):
        return own is not None and own in f.value
    tests = {EqualTo: lambda v: own == v, GreaterThan: lambda v: own > v, GreaterThanOrEqual: lambda v: own >= v, LessThan: lambda v: own < v, LessThanOrEqual: lambda v: own <= v}
    tests |= {StringStartsWith: lambda v: own.startswith(v), StringEndsWith: lambda v: own.endswith(v)}
    return None if type(f) not in tests else own is not None and tests[type(f)](f.value)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}  # Spark's options know no case
        self.root = options["path"]
        self.limit = int(options.get("limit", 1 << 62))
        self.too_large, self.empty = options.get("toolarge", "size-limit"), options.get("empty", "size-limit")
        self.recursive = options.get("recursive", "true") == "true"
        self.extensions = {e for e in options.get("extensions", "").split(",") if e}
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps those that the list can answer; the others stay Spark's."""
        for f in filters:
            if admits(f, {"path": "", "name": "", "bytes": 0, "error_code": ""}) is None:
                yield f
            else:
                self.filters.append(f)

    def listed(self) -> Iterator[tuple[str, int, str | None]]:
        system, root = opened(self.root)
        info = system.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=self.recursive))
        for f in sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.path):
            steps = f.path[len(root) :].split("/")
            if any(s.startswith((STAGING, "_", ".")) for s in steps[:-1] if s) or steps[-1].startswith(("_SUCCESS", ".")):
                continue  # what other writers have not committed, and their notes
            name = posixpath.basename(f.path)
            if self.extensions and name.rpartition(".")[2].lower() not in self.extensions:
                continue
            error = self.empty or None if not f.size else self.too_large if f.size > self.limit else None
            if all(admits(x, {"path": f.path, "name": name, "bytes": f.size, "error_code": error}) for x in self.filters):
                yield f.path, f.size, error

    def partitions(self) -> list[InputPartition]:
        """Files in the order of their paths, cut where a task has bytes or files enough."""
        out: list[list[tuple[str, int, str | None]]] = [[]]
        size = 0
        for f in self.listed():
            if out[-1] and (size + f[1] > self.partition_bytes or len(out[-1]) >= PARTITION_FILES):
                out.append([])
                size = 0
            out[-1].append(f)
            size += 0 if f[2] else f[1]
        return [Listed(files) for files in out]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("content", pa.binary()), ("error_code", pa.string())])
        rows: list[tuple] = []
        held = 0
        for path, size, error in partition.files:
            content = None
            if error is None:
                with system.open_input_stream(path) as stream:
                    content = stream.read()
                size = len(content)
            rows.append((path, posixpath.basename(path), size, content, error))
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """Where a task attempt wrote, and how many files; nothing for a task without rows."""

    folder: str | None
    files: int


def safe_name(name: str | None) -> str:
    """A name without path steps or odd characters, of at most 200 characters."""
    out = UNSAFE.sub("_", (name or "").replace("/", "_"))[-200:].lstrip(". ")
    return out or "file"


class FolderWriter(DataSourceArrowWriter):
    """Writes (name, content) rows; content may be binary or string, rows with null content have no file."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root = options["path"]
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.root)
        folder = f"{root}/{STAGING}{self.job}/{uuid.uuid4().hex}"  # of this attempt alone
        used: dict[str, int] = {}
        files = 0
        for batch in iterator:
            for name, content in zip(batch.column(batch.schema.get_field_index("name")), batch.column(batch.schema.get_field_index("content"))):
                if not content.is_valid:
                    continue
                if not files:
                    system.create_dir(folder, recursive=True)
                data = content.as_py()
                with system.open_output_stream(f"{folder}/{self.distinct(safe_name(name.as_py()), used)}") as out:
                    out.write(data.encode() if isinstance(data, str) else data)
                files += 1
        return Written(folder if files else None, files)

    @staticmethod
    def distinct(name: str, used: dict[str, int]) -> str:
        """``name``, with a number before its extension if the task has used it."""
        stem, dot, end = name.partition(".")
        out = name
        while out.lower() in used:  # some file systems know no case
            used[name.lower()] += 1
            out = f"{stem}-{used[name.lower()]}{dot}{end}"
        used[out.lower()] = used.get(out.lower(), 1)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory and posixpath.basename(f.path).startswith("part-")]
        for n, m in enumerate(m for m in messages if m is not None and m.folder):
            system.move(m.folder, f"{root}/part-{n:05d}-{self.job}")
        for path in old if self.overwrite else []:
            system.delete_dir(path)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, root = opened(self.root)
        staging = f"{root}/{STAGING}{self.job}"
        if system.get_file_info(staging).type == pafs.FileType.Directory:
            system.delete_dir(staging)


class WholeFiles(DataSource):
    """Options: path; for reading limit, tooLarge and empty (error codes), recursive, extensions, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``whole_files`` known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WholeFiles)


def read(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """(path, name, bytes, content, error_code) of the files below ``path``."""
    register(spark)
    return spark.read.format(NAME).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load(path)


def write(files: DataFrame, path: str, name_col: str, content_col: str, mode: str = "append") -> None:
    """One file for each row with content, below ``path``: ``part-<task>-<job>/<name>``.

    Names lose path steps and odd characters, and rows of one name in a task get
    numbers; tasks have folders of their own, so no shuffle makes names distinct.
    ``mode`` is append, or overwrite, which takes away the files of earlier jobs once the new ones are there.
    """
    register(files.sparkSession)
    position = files.columns.index
    flat = files.toDF(*[f"_{i}" for i in range(len(files.columns))])
    flat.selectExpr(f"_{position(name_col)} as name", f"_{position(content_col)} as content").write.format(NAME).mode(mode).save(path)
