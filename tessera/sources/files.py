"""Markdown files as a table: path, text, encoding, error.

``markdown_files`` is a Python data source.  The driver lists the first levels of the tree only, until there are folders
enough to deal; each task then lists its folders with all below them and reads their files, so neither the listing nor the
files pass through the driver.  A file or folder that cannot be read gives a row with an error, and only an unreadable root
fails.  Files in a store that only Spark reads come in by ``stored_files``, over the built-in binary source.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.decode import decoded
from tessera.sources.config import Root

#: The driver stops going down once it knows so many folders, or at this depth; it deals them to so many tasks at most.
FOLDERS, DEPTH, TASKS = 256, 3, 1024
FILES_A_TASK = 256


class _Slice(InputPartition):
    """Files to read, folders to go down into, and errors that the driver met; paths are relative to the root."""

    def __init__(self, files: list[str], folders: list[str], errors: list[tuple[str, str]]):
        self.files, self.folders, self.errors = files, folders, errors


def _level(root: str, folder: str) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Files, folders and errors right below a folder, in order; what begins with a dot is not looked at."""
    files, folders = [], []
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            entries = sorted((e for e in found if not e.name.startswith(".")), key=lambda e: e.name)
    except OSError as e:
        return [], [], [(folder, str(e.strerror))]
    for e in entries:
        path = f"{folder}/{e.name}" if folder else e.name
        if e.is_dir() and not e.is_symlink():
            folders.append(path)
        elif e.name.lower().endswith(".md"):
            files.append(path)
    return files, folders, []


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Slice]:
        os.listdir(self.root)  # an unreadable root fails the scan
        files: list[str] = []
        errors: list[tuple[str, str]] = []
        folders, depth = [""], 0
        while folders and len(folders) < FOLDERS and depth < DEPTH:
            below: list[str] = []
            for own, deeper, failed in (_level(self.root, f) for f in folders):
                files, below, errors = files + own, below + deeper, errors + failed
            folders, depth = below, depth + 1
        slices = [_Slice(files[i : i + FILES_A_TASK], [], []) for i in range(0, len(files), FILES_A_TASK)]
        each = -(-len(folders) // TASKS)
        slices += [_Slice([], folders[i : i + each], []) for i in range(0, len(folders), each or 1)]
        return [*slices, _Slice([], [], errors)] if errors or not slices else slices

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path, why in partition.errors:
            yield path, None, why
        yield from map(self._row, partition.files)
        waiting = partition.folders[::-1]
        while waiting:
            files, folders, errors = _level(self.root, waiting.pop())
            for path, why in errors:
                yield path, None, why
            yield from map(self._row, files)
            waiting += folders[::-1]

    def _row(self, path: str) -> tuple:
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                return path, f.read(), None
        except OSError as e:
            return path, None, str(e.strerror)


class MarkdownFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return "path string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def excluded(path: Column, entries: Iterable[str]) -> Column:
    """Whether an entry is the path, its file name, or a folder above it."""
    hit = F.lit(False)
    for e in entries:
        e = e.rstrip("/")
        hit = hit | (path == e) | (F.substring_index(path, "/", -1) == e) | path.startswith(f"{e}/")
    return hit


def as_text(files: DataFrame) -> DataFrame:
    d = files.withColumn("_d", decoded(F.col("content")))
    return d.select("path", F.col("_d.text").alias("text"), F.col("_d.encoding").alias("encoding"), F.coalesce("error", "_d.error").alias("error"))


def scan_root(spark: SparkSession, root: Root, exclude: Iterable[str] = ()) -> DataFrame:
    spark.dataSource.register(MarkdownFiles)
    files = spark.read.format("markdown_files").load(root.path).where(~excluded(F.col("path"), exclude))
    path = F.concat(F.lit(f"{root.alias}/"), "path") if root.alias else F.col("path")
    return as_text(files).withColumn("path", path)


def scan(spark: SparkSession, roots: list[Root], exclude: Iterable[str] = ()) -> DataFrame:
    """All roots; one that fails gives one error row under its alias, and only if all fail does the scan fail."""
    good, bad = [], []
    for r in roots:
        try:
            os.listdir(r.path)
            good.append(scan_root(spark, r, exclude))
        except OSError as e:
            bad.append((r.alias or r.path, None, None, str(e.strerror)))
    if not good:
        raise OSError("; ".join(f"{b[0]}: {b[3]}" for b in bad))
    if bad:
        good.append(spark.createDataFrame(bad, "path string, text string, encoding string, error string"))
    return reduce(DataFrame.unionByName, good)


def stored_files(spark: SparkSession, path: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Files below any path that Spark can open; names that start with a dot or an underscore are hidden there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(path)
    base = found.select(F.regexp_replace("path", r"^\w+:/*", "/").alias("full"), "content")
    root = "/" + path.split(":", 1)[-1].strip("/") + "/"
    files = base.select(F.regexp_replace("full", f"^{root}", "").alias("path"), "content", F.lit(None).cast("string").alias("error"))
    return as_text(files.where(~excluded(F.col("path"), exclude)))
