"""Files that tasks open by themselves: parts of large ones, and files with given names."""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql import functions as F

_SCHEMES = ("", "file", "s3", "gs", "hdfs")


def reachable(path: str) -> bool:
    """Whether tasks can open such a path without Spark."""
    m = re.match(r"([a-z0-9]+):", path)
    return (m[1] if m else "") in _SCHEMES


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def opened(path: str) -> pa.NativeFile:
    """A file whose parts can be read."""
    where, name = located(path)
    return where.open_input_file(name)


def _walk(pattern: str, deep: bool):
    """Rows (path, folder) -> files as they are, folders' members instead of them; with deep=True all files below. What Spark's readers leave
    out, empty files and names that begin with _ or a dot, is left out."""
    hidden = re.compile(r"_[^=]*$|\.")

    def members(where, name, prefix):
        for x in where.get_file_info(fs.FileSelector(name)):
            if hidden.match(x.base_name):
                continue
            folder = x.type == fs.FileType.Directory
            if folder and deep:
                yield from members(where, x.path, prefix)
            elif folder or x.size and fnmatch.fnmatchcase(x.base_name, pattern):
                yield prefix + x.path, folder

    def run(batches):
        for batch in batches:
            rows = []
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                if folder:
                    where, name = located(path)
                    rows += members(where, name, _prefix(path))
                else:
                    rows.append((path, False))
            paths, folders = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], names=["path", "folder"])

    return run


def _prefix(path: str) -> str:
    """What stands before a file system's own name of a file in its path."""
    m = re.match(r"([a-z0-9]+)://([^/]*)", path)
    if not m or m[1] == "file":
        return "file:"
    return f"{m[1]}://{m[2]}" if m[1] == "hdfs" else f"{m[1]}://"


def tasks(spark: SparkSession) -> int:
    """Tasks that files are dealt to: their names are few bytes, by which Spark would join the tasks to one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path of each file below root whose name fits the pattern. Tasks list folders: two levels one after another, so that their folders are
    dealt out, and then what is below. Where tasks can't, or the root is a pattern itself, Spark lists, with a task for each folder."""
    if not reachable(root) or re.search(r"[*?\[{]", root):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    where, name = located(root)
    folder = where.get_file_info(name).type != fs.FileType.File
    d, kind = spark.range(1).select(F.lit(root).alias("path"), F.lit(folder).alias("folder")), "path string, folder boolean"
    for deep in (False, False, True):
        d = d.repartition(tasks(spark), "path").mapInArrow(_walk(pattern, deep), kind)
    return d.select("path")


#: Bytes of the texts of a batch.
TEXTS = 8 << 20


def _read(batches):
    paths, values, size = [], [], 0
    table = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], names=["path", "value"])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with opened(path) as f:
                paths.append(path)
                values.append(f.read())
            size += len(values[-1])
            if size > TEXTS:
                yield table()
                paths, values, size = [], [], 0
    if paths:
        yield table()


def whole_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, value: the small files below root, each as one text; a task reads many of them."""
    if not reachable(root):
        return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")
    return listed(spark, root, pattern).repartition(tasks(spark), "path").mapInArrow(_read, "path string, value binary").withColumn("value", F.col("value").cast("string"))


@dataclass
class _Written(WriterCommitMessage):
    staged: str


#: Moves at a time.
THREADS = 16


def _moved(where: fs.FileSystem, staged: str, target: str) -> list[tuple[str, str]]:
    """Moves a file, or a folder where there is none of its name; else tells which of its members to move where. Stores without folders move
    files only."""
    whole = isinstance(where, fs.LocalFileSystem | fs.HadoopFileSystem)
    new, old = where.get_file_info([staged, target])
    if new.type == fs.FileType.Directory and (old.type == fs.FileType.Directory or not whole):
        return [(x.path, posixpath.join(target, x.base_name)) for x in where.get_file_info(fs.FileSelector(staged))]
    where.move(staged, target)
    return []


class _NamedFiles(DataSourceArrowWriter):
    """Rows (path, value) in order of path -> a file for each path. Tasks write below _staging; commit moves what the tasks that counted have
    written into place, so a task that fails or runs twice leaves nothing behind that a reader sees."""

    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.root}/_staging/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, top = located(f"{self.staging}/{TaskContext.get().taskAttemptId()}")
        name, out, made = None, None, None
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                runs = pa.compute.run_end_encode(batch.column("path"))
                # the values of a run stand one after another in the column's buffer
                values = batch.column("value").cast(pa.large_string())
                _, ends, data = values.buffers()
                ends, start = np.frombuffer(ends, np.int64)[values.offset :], 0
                for path, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if path != name:
                        if out is not None:
                            out.close()
                        if posixpath.isabs(path) or ".." in path.split("/"):
                            raise ValueError(f"{path} is no path below the folder")
                        folder = posixpath.dirname(posixpath.join(top, path))
                        if folder != made:
                            where.create_dir(folder, recursive=True)
                        name, made, out = path, folder, where.open_output_stream(posixpath.join(top, path), compression=None)
                    if ends[stop] > ends[start]:
                        out.write(data.slice(int(ends[start]), int(ends[stop] - ends[start])))
                    start = stop
        finally:
            if out is not None:
                out.close()
        return _Written(top)

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = located(self.root)
        where.create_dir(root, recursive=True)
        with ThreadPoolExecutor(THREADS) as pool:
            for m in messages:  # one task's after another's, so that no two move the same folder
                some = [(m.staged, root)] if m and where.get_file_info(m.staged).type == fs.FileType.Directory else []
                while some:
                    some = [x for more in pool.map(lambda pair: _moved(where, *pair), some) for x in more]
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        where, staging = located(self.staging)
        for folder in (staging, posixpath.dirname(staging)):
            if where.get_file_info(folder).type == fs.FileType.Directory and (folder == staging or not where.get_file_info(fs.FileSelector(folder))):
                where.delete_dir(folder)


class NamedFiles(DataSource):
    """df.write.format("named_files").mode("append").save(folder), df: path, value."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _NamedFiles(self.options["path"])


def write_named(df: DataFrame, folder: str, by: str = "place", together: str = "path") -> None:
    """path, value and an order -> files below the folder: each path's values one after another, as they are. A file of the same name is
    replaced. A file is written by one task as a stream, so its size is no matter; files are dealt out by their names, or by another column
    that is the same in a folder's files, which are then made in one task."""
    if not reachable(folder):
        raise ValueError(f"{folder} is in a store that tasks can't open by themselves")
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(NamedFiles)
    rows = df.repartition(together).sortWithinPartitions("path", by).select("path", F.coalesce("value", F.lit("")).alias("value"))
    rows.write.format("named_files").mode("append").save(folder)
