"""A sink of whole files, and their listing and bytes.

Files written are bytes at paths of their own, there as a whole or not at all.

Every task writes its files aside, below a folder of its attempt, and commits their names; when all tasks have, the driver moves each into place.
A task that fails or is repeated leaves nothing at any target; a job that fails deletes what its tasks wrote aside, and one that is run again
writes the same bytes to the same paths.  Files go to any file system that Arrow knows by its URI; a path without a scheme is a local one.
Targets are expected to be distinct: of several rows with one path the last that is moved stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatchcase
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "whole_files"
#: The sink's folders below ``aside``.
_ASIDE = re.compile(r"_aside-[0-9a-f]{32}(-gone)?")


def plain(path: str) -> str:
    """A local path without ``file:`` and with single slashes; other URIs as they are."""
    return path if "://" in path and not path.startswith("file:") else re.sub("/+", "/", path.removeprefix("file:"))


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path on it."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), plain(path)
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (name aside, target) of each file."""

    files: list[tuple[str, str]] = field(default_factory=list)


class WholeFileWriter(DataSourceArrowWriter):
    """``aside`` is a folder on the targets' file system; (path, content) rows go there first.

    The driver makes the job's folder below it, and no task does: one that outlives its job finds the folder gone and fails.  That
    doesn't hold on object stores, which have no folders.
    """

    def __init__(self, aside: str, overwrite: bool):
        self.aside, self.overwrite = f"{aside.rstrip('/')}/_aside-{uuid4().hex}", overwrite
        fs, root = file_system(self.aside)
        fs.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.aside)
        done, attempt = Written(), uuid4().hex
        fs.create_dir(f"{root}/{attempt}", recursive=False)
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = f"{attempt}/{len(done.files)}"
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                done.files.append((name, path))
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.aside)
        for message in messages:
            for name, path in message.files if isinstance(message, Written) else []:
                _, target = file_system(path)
                if not self.overwrite and fs.get_file_info(target).type != arrow_fs.FileType.NotFound:
                    continue  # an earlier run of the same job put it there
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                fs.move(f"{root}/{name}", target)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.aside)
        if fs.get_file_info(root).type == arrow_fs.FileType.NotFound:
            return
        try:  # away at once, as tasks may still be writing there
            fs.move(root, f"{root}-gone")
            root = f"{root}-gone"
        except (OSError, NotImplementedError):
            pass  # an object store doesn't move folders
        fs.delete_dir(root)


class WholeFiles(DataSource):
    """``df.write.format("whole_files").option("aside", folder)`` for rows (path, content)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> WholeFileWriter:
        if {f.name for f in schema} != {"path", "content"}:
            raise ValueError("rows are (path, content)")
        return WholeFileWriter(self.options["aside"], self.options.get("replace", "true") == "true")


def write_files(files: DataFrame, aside: str | None = None, path_col: str = "output_path", replace: bool = True) -> None:
    """Write ``content`` to the path in ``path_col``; ``aside``: a folder on the same file system, by default where the first target is to be.

    Without ``replace`` a file that is there stays as it is.
    """
    rows = files.select(files[path_col].alias("path"), "content")
    if aside is None:
        first = rows.select("path").first()
        if first is None:
            return
        aside = first[0].rsplit("/", 1)[0]
    spark = files.sparkSession
    spark.dataSource.register(WholeFiles)
    rows.write.format(NAME).mode("append").option("aside", aside).option("replace", str(replace).lower()).save()


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of all files below ``folder`` when it is run; no file is opened.  Paths are without ``file:``.

    Spark's own file sources leave out empty files and names that begin with ``_`` or ``.``, which are listed here; what the sink holds
    aside is not.  One task lists ``folder`` itself, then several what is below its folders.  ``pattern`` is one of ``fnmatch``, for names.
    """
    top = spark.sparkContext.parallelize([(plain(folder), None, None)], 1)
    first = top.flatMap(lambda entry: ((x[0], x) for x in _entries(entry[0], False, pattern)))
    found = first.partitionBy(spark.sparkContext.defaultParallelism).flatMap(lambda entry: _files(entry[1], pattern))
    # an RDD's size is unknown to the planner; by that of the few folders it would send all files to every task
    rows = spark.createDataFrame(found, "path string, size bigint, micros bigint", verifySchema=False)
    return rows.select("path", "size", F.timestamp_micros("micros").alias("modified"))


def _files(entry: tuple, pattern: str) -> Iterator[tuple]:
    """A file as it is, or all files below a folder."""
    held = [entry]
    while held:
        entry = held.pop()
        if entry[1] is None:
            held += _entries(entry[0], True, pattern)
        else:
            yield entry


def _entries(folder: str, may_be_gone: bool, pattern: str) -> Iterator[tuple[str, int | None, int | None]]:
    """(path, size, microseconds) of what ``folder`` has itself; the size of folders is null."""
    fs, root = file_system(folder)
    for x in fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=may_be_gone)):
        try:
            name = x.base_name
        except UnicodeDecodeError:
            continue  # no text has such a path
        if x.type == arrow_fs.FileType.Directory and not _ASIDE.fullmatch(name):
            yield f"{folder.rstrip('/')}/{name}", None, None
        elif x.type == arrow_fs.FileType.File and fnmatchcase(name, pattern):
            yield f"{folder.rstrip('/')}/{name}", x.size, None if x.mtime_ns is None else x.mtime_ns // 1000


def with_bytes(rows: DataFrame, path_col: str = "path", batch_bytes: int = 4 << 20) -> DataFrame:
    """``rows`` with the ``content`` of the file at ``path_col``: only these files are read, null where there is none or no path."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at = rows.columns.index(path_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, held = 0, 0, []
            for k, path in enumerate(batch.column(at).to_pylist()):
                held.append(_content(path))
                size += len(held[-1] or b"")
                if size >= batch_bytes or k == batch.num_rows - 1:
                    own = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(held, pa.binary())], [*own.schema.names, "content"])
                    first, size, held = k + 1, 0, []

    return rows.mapInArrow(run, f"{kinds}, content binary")


def _content(path: str | None) -> bytes | None:
    if path is None:
        return None
    fs, name = file_system(path)
    if fs.get_file_info(name).type != arrow_fs.FileType.File:
        return None
    with fs.open_input_stream(name, compression=None) as source:
        return source.read()
