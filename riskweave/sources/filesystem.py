"""Directory trees as DataFrames: a Python data source for metadata alone, and file contents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.files import Exclusions

SCHEMA = "path string, relative_path string, name string, size bigint, mtime double, ctime double, atime double, depth int, uid int, gid int, mode int, inode bigint, nlink int, is_hidden boolean, is_symlink boolean, is_readonly boolean, is_executable boolean, error string"


class FileTree(DataSource):
    """``spark.read.format("file_tree").load(root)``; options max_depth (100), skip_hidden (true), skip_dirs (true) and split (2): directories down to this depth are tasks of their own.

    Links to directories aren't followed. A file that can't be read gives a row
    with its error. The root must be a folder that every executor sees.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Part(InputPartition):
    def __init__(self, folder: str, depth: int, deep: bool):
        self.folder, self.depth, self.deep = folder, depth, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.max_depth = int(options.get("max_depth", 100))
        self.split = int(options.get("split", 2))
        self.skip_hidden = options.get("skip_hidden", "true").lower() == "true"
        self.skip = frozenset(Exclusions().skip_dirs) if options.get("skip_dirs", "true").lower() == "true" else frozenset()

    def _wanted(self, e: os.DirEntry) -> bool:
        return e.is_dir(follow_symlinks=False) and e.name not in self.skip and not (self.skip_hidden and e.name.startswith("."))

    def partitions(self) -> list[InputPartition]:
        """The own files of each directory above the split, and each whole directory at it."""
        parts, level = [], [self.root]
        for depth in range(max(0, min(self.split, self.max_depth + 1))):
            parts += [_Part(f, depth, False) for f in level]
            below = []
            for folder in level:
                try:
                    with os.scandir(folder) as it:
                        below += sorted(e.path for e in it if self._wanted(e))
                except OSError:
                    pass  # the task of this folder gives the row with its error
            level = below if depth < self.max_depth else []
        return parts + [_Part(f, self.split, True) for f in level]

    def _files(self, folder: str, depth: int, deep: bool) -> Iterator[tuple]:
        try:
            with os.scandir(folder) as it:
                entries = sorted(it, key=lambda e: e.name)
        except OSError as x:
            yield (folder, os.path.relpath(folder, self.root), os.path.basename(folder), *[None] * 10, False, False, None, None, str(x))
            return
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if deep and depth < self.max_depth and self._wanted(e):
                    yield from self._files(e.path, depth + 1, True)
            elif not (self.skip_hidden and e.name.startswith(".") and not e.name.startswith(".env")):
                relative = os.path.relpath(e.path, self.root)
                try:
                    s = e.stat()
                    yield (e.path, relative, e.name, s.st_size, s.st_mtime, s.st_ctime, s.st_atime, depth, s.st_uid, s.st_gid, s.st_mode, s.st_ino, s.st_nlink, e.name.startswith("."), e.is_symlink(), not s.st_mode & 0o222, bool(s.st_mode & 0o111), None)
                except OSError as x:
                    yield (e.path, relative, e.name, *[None] * 10, e.name.startswith("."), e.is_symlink(), None, None, str(x))

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from self._files(partition.folder, partition.depth, partition.deep)


def inventory(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").options(**options).load(root)


def contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size, mtime and content of all files below a root."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), "content")


def heads(files: DataFrame, most: int = 65536) -> DataFrame:
    """path and its first bytes, for an inventory whose folder every executor sees; a file of any size is read no further. Null for one that can't be read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[bytes | None] = []
            for path in f["path"]:
                try:
                    with open(path, "rb") as x:
                        out.append(x.read(most))
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"path": f["path"], "content": out})

    return files.select("path").mapInPandas(read, "path string, content binary")


def text_of(content):
    """UTF-8 text; what isn't valid UTF-8 is taken as Latin-1."""
    return F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
