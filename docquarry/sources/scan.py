"""Folders as tables of files: a Python data source, as Spark's own reader of binary files hides some
names and follows links.

The driver lists paths; contents are read by the tasks, and only if the column is asked for.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import FILES

FILES_A_TASK = 64


def canonical(path: str) -> str:
    """The real path; of a path that is gone, the real folder's with its name; else the path itself."""
    if os.path.exists(path):
        return os.path.realpath(path)
    folder, name = os.path.split(os.path.abspath(path))
    return os.path.join(os.path.realpath(folder), name) if os.path.isdir(folder) else path


def regular_files(root: str) -> list[str]:
    """Regular files below a folder, links not followed; what can't be listed is left out."""
    found = []
    for folder, _, names in os.walk(canonical(root), followlinks=False):
        found += [p for n in names if not os.path.islink(p := os.path.join(folder, n)) and os.path.isfile(p)]
    return sorted(found)


def rfc3339(seconds: float) -> str:
    shown = datetime.fromtimestamp(seconds, UTC)
    return shown.isoformat().replace("+00:00", "Z")


def file_row(path: str, content: bool) -> tuple | None:
    """``path, length, modified_at, content``; None for a file that went meanwhile."""
    try:
        found = os.stat(path)
        data = None
        if content:
            with open(path, "rb") as f:
                data = f.read()
        return path, found.st_size, rfc3339(found.st_mtime), data
    except OSError:
        return None


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.named, self.content = options.get("path"), options.get("files"), options.get("content", "true") == "true"
        self.most = int(options.get("maxlength", "0")) or None

    def partitions(self) -> list[InputPartition]:
        paths = json.loads(self.named) if self.named else regular_files(self.root)
        return [_Part(paths[i : i + FILES_A_TASK]) for i in range(0, len(paths), FILES_A_TASK)] or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                small = self.most is None or os.path.getsize(path) <= self.most
            except OSError:
                continue
            row = file_row(path, self.content and small)
            if row:
                yield row


class FolderSource(DataSource):
    """``format("docquarry_folder")``, with ``path`` (or ``files``, a JSON list of paths), ``content`` (true) and ``maxLength``, beyond
    which contents are null."""

    @classmethod
    def name(cls) -> str:
        return "docquarry_folder"

    def schema(self) -> StructType:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def scan_folder(spark: SparkSession, root: str, content: bool = True, max_length: int | None = None) -> DataFrame:
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("docquarry_folder").option("path", root).option("content", str(content).lower())
    return (reader.option("maxLength", str(max_length)) if max_length else reader).load()


def scan_files(spark: SparkSession, paths: list[str], max_length: int) -> DataFrame:
    """The files of the given paths that exist."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("docquarry_folder").option("files", json.dumps(paths)).option("maxLength", str(max_length)).load()
