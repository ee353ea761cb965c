"""Changes of a folder as a stream: snapshots of paths, sizes and times are compared.

Reading a file changes none of these, so indexing never wakes itself; deletions and rewrites show.
Snapshots are numbered files in a folder of the stream's own; an offset is such a number.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from .scan import regular_files

SCHEMA = StructType([StructField("path", StringType()), StructField("kind", StringType()), StructField("ts", TimestampType())])
CREATE, MODIFY, DELETE = "create", "modify", "delete"


def snapshot(root: str) -> dict[str, list[int]]:
    """Size and time in nanoseconds of every regular file."""
    out = {}
    for path in regular_files(root):
        try:
            found = os.stat(path)
            out[path] = [found.st_size, found.st_mtime_ns]
        except OSError:
            pass
    return out


def difference(before: dict[str, list[int]], after: dict[str, list[int]]) -> list[tuple[str, str]]:
    """``(path, kind)`` in order of paths."""
    kinds = {p: CREATE if p not in before else MODIFY for p in after if before.get(p) != after[p]}
    return sorted((kinds | dict.fromkeys(before.keys() - after.keys(), DELETE)).items())


#: Snapshots that are kept behind the last one committed.
KEPT = 10


def _at(seen: str, n: int) -> str:
    return os.path.join(seen, f"{n:012d}.json")


def _write(seen: str, n: int, found: dict[str, list[int]]) -> None:
    """Whole or not at all."""
    os.makedirs(seen, exist_ok=True)
    with open(_at(seen, n) + ".part", "w", encoding="utf-8", errors="surrogateescape") as f:
        json.dump(found, f)
    os.replace(_at(seen, n) + ".part", _at(seen, n))


def _read(seen: str, n: int) -> dict[str, list[int]]:
    with open(_at(seen, n), encoding="utf-8", errors="surrogateescape") as f:
        return json.load(f)


def begin(seen: str, root: str | None) -> None:
    """Notes what a folder is now (nothing without one), unless a stream has begun already."""
    if not os.path.isdir(seen) or not any(n.endswith(".json") for n in os.listdir(seen)):
        _write(seen, 0, snapshot(root) if root else {})


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.seen, self.quiet = options["path"], options["seen"], int(options.get("debouncems", "0")) / 1000

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, after = _read(self.seen, start["n"]), snapshot(self.root)
        while self.quiet and after != before:  # one global session: any further change prolongs it
            time.sleep(self.quiet)
            again = snapshot(self.root)
            if again == after:
                break
            after = again
        found = difference(before, after)
        if not found:
            return iter([]), start
        _write(self.seen, start["n"] + 1, after)
        now = datetime.now(UTC)
        return iter([(p, k, now) for p, k in found]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        now = datetime.now(UTC)
        return iter([(p, k, now) for p, k in difference(_read(self.seen, start["n"]), _read(self.seen, end["n"]))])

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.seen):
            if name.endswith(".json") and int(name[:-5]) < end["n"] - KEPT:
                os.remove(os.path.join(self.seen, name))


class ChangeSource(DataSource):
    """``format("docquarry_changes")``, with ``path``, ``seen`` (the snapshots' folder, begun by ``begin``) and
    ``debounceMs``: changes come once nothing has changed for so long, as one batch."""

    @classmethod
    def name(cls) -> str:
        return "docquarry_changes"

    def schema(self) -> StructType:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


def watch_folder(spark: SparkSession, root: str, seen: str, debounce_ms: int = 0) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("docquarry_changes").option("path", root).option("seen", seen).option("debounceMs", str(debounce_ms)).load()
