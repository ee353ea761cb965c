"""An index as segments of Parquet tables below one folder, on any file system that Spark writes.

A version names, for each table, its segments and its marks.  A mark is a key whose rows in earlier segments
are gone, so that a change writes its own rows and marks and nothing else.  Segments of about one size are
merged once there are ``FAN`` of them: a row is rewritten about as often as there are powers of ``FAN``
between a change and the index.

A version is one small file, put in place by a rename that fails if it is there: of two writers that begin
from the same version one gets a conflict, and readers see a version whole or not at all.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, IndexingError
from ..schema import KEYS, LAYOUT, TABLES
from .postings import laid_out

#: So many segments of one size become one; so many files of marks, too.
FAN = 8
#: Segments below this many bytes are of one size.
SMALL = 1 << 20
MARKS = "key string, at long"
#: Marks up to this many bytes of files go to all tasks, so that no row is shuffled for them.
BROADCAST_MARKS = 32 << 20


@dataclass(frozen=True)
class Change:
    """What a version does to a table: the keys (one column) whose rows go, and the rows that come then.

    Rows may be made from what the version has written to earlier tables of the same change, by their names.
    """

    rows: DataFrame | Callable[[dict[str, DataFrame]], DataFrame] | None = None
    gone: DataFrame | None = None


@dataclass(frozen=True)
class Snapshot:
    """One version, which later ones leave as it is."""

    store: IndexStore
    version: int
    layout: int
    tables: dict[str, dict[str, list[dict]]]

    def read(self, name: str) -> DataFrame:
        parts = self.tables.get(name, {"segments": [], "gone": []})
        return self.store.rows(name, parts["segments"], parts["gone"])


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def snapshot(self) -> Snapshot:
        """The newest version; version 0 is empty."""
        numbers = self._versions()
        if not numbers:
            return Snapshot(self, 0, 0, {})
        return self._load(numbers[-1])

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max(self._versions(), default=0)

    def layout(self) -> int:
        return self.snapshot().layout

    def migrate(self) -> int:
        """Brings the layout up to date, any number of times; a newer one than this code's is an error.

        An index of none gets its first, empty version.  Layout 1 had whole tables in a catalog of
        Parquet; its newest ones become the first segments.
        """
        found = self.snapshot()
        if found.layout > LAYOUT:
            raise IndexingError(f"layout {found.layout} is newer than {LAYOUT}")
        if found.layout < LAYOUT:
            self._commit(Snapshot(self, 1, LAYOUT, self._first_layout()))
        return self.layout()

    def _first_layout(self) -> dict:
        files, catalog = self._at("catalog")
        if not files.exists(catalog):
            return {}
        rows = self.spark.read.parquet(f"{self.root}/catalog")
        newest = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).select("table", "location").collect()  # one row a table
        return {r["table"]: {"segments": [self._entry(r["location"], 1)], "gone": []} for r in newest}

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def rows(self, name: str, segments: list[dict], gone: list[dict]) -> DataFrame:
        """The rows of segments without those that a later mark takes out."""
        spark, schema, key = self.spark, TABLES[name], KEYS[name]
        paths = lambda entries: [f"{self.root}/{e['location']}" for e in entries]
        last = max((g["at"] for g in gone), default=0)
        whole = [s for s in segments if s["at"] >= last]
        out = spark.read.schema(schema).parquet(*paths(whole)) if whole else None
        marked = None
        for s in segments:
            if s["at"] < last:
                one = spark.read.schema(schema).parquet(*paths([s])).withColumn("__at", F.lit(s["at"]).cast("long"))
                marked = one if marked is None else marked.unionByName(one)
        if marked is not None:
            marks = spark.read.schema(MARKS).parquet(*paths(gone)).toDF("__key", "__gone")
            if sum(g["bytes"] for g in gone) <= BROADCAST_MARKS:
                marks = F.broadcast(marks)
            left = marked.join(marks, (F.col(key) == F.col("__key")) & (F.col("__gone") > F.col("__at")), "left_anti").select(*schema.names)
            out = left if out is None else out.unionByName(left)
        return spark.createDataFrame([], schema) if out is None else out

    def publish(self, changes: dict[str, Change], base: Snapshot | None = None) -> int:
        """Makes the next version of ``base``, which must still be the newest; tables not named stay."""
        base = base or self.snapshot()
        version, tables, marks = base.version + 1, dict(base.tables), {}
        written: dict[str, DataFrame] = {}
        for name, change in changes.items():
            parts = tables.get(name, {"segments": [], "gone": []})
            segments, gone = list(parts["segments"]), list(parts["gone"])
            if change.gone is not None and segments:
                if id(change.gone) not in marks:  # tables that lose the same keys share their marks
                    marks[id(change.gone)] = self._write(change.gone.toDF("key").distinct().withColumn("at", F.lit(version).cast("long")), "gone", version)
                gone += marks[id(change.gone)]
            if change.rows is not None:
                rows = change.rows(written) if callable(change.rows) else change.rows
                new = self._write(rows.select(*TABLES[name].names), f"tables/{name}", version)
                written[name] = self.rows(name, new, [])
                segments += new
            tables[name] = self._merged(name, segments, gone, version)
        self._commit(Snapshot(self, version, LAYOUT, tables))
        return version

    def compact(self) -> int:
        """A version of the same rows in one segment a table, without marks."""
        base = self.snapshot()
        version = base.version + 1
        tables = {name: {"segments": self._one(name, parts["segments"], parts["gone"], version), "gone": []} for name, parts in base.tables.items()}
        self._commit(Snapshot(self, version, LAYOUT, tables))
        return version

    def vacuum(self, keep: int = 10, hours: float = 24) -> int:
        """Deletes versions but the last ``keep``, and what only they had; how many segments and marks went.

        What was the newest version at any time in the last ``hours`` stays, as it may be being read, and so
        do younger files, as they may be of a version that is being written.
        """
        before, went, kept, old = (time.time() - hours * 3600) * 1000, 0, [], []
        numbers = self._versions()
        for n, later in zip(numbers, [*numbers[1:], None], strict=True):
            files, path = self._at(f"versions/{later or n:012d}.json")
            recent = later is None or n in numbers[-keep:] or files.getFileStatus(path).getModificationTime() >= before
            (kept if recent else old).append(n)
        used = {e["location"] for n in kept for parts in self._load(n).tables.values() for e in parts["segments"] + parts["gone"]}
        for n in old:
            files, path = self._at(f"versions/{n:012d}.json")
            files.delete(path, False)
        for folder in ("gone", *(f"tables/{name}" for name in TABLES)):
            files, path = self._at(folder)
            for status in files.listStatus(path) if files.exists(path) else ():
                if f"{folder}/{status.getPath().getName()}" not in used and status.getModificationTime() < before:
                    files.delete(status.getPath(), True)
                    went += 1
        return went

    def put_body(self, document_id: str, body: str) -> None:
        new = self.spark.createDataFrame([(document_id, body)], TABLES["document_bodies"])
        self.publish({"document_bodies": Change(new, new.select("document_id"))})

    def get_body(self, document_id: str) -> str | None:
        row = self.read("document_bodies").where(F.col("document_id") == document_id).select("body").first()
        return None if row is None else row["body"]

    def _merged(self, name: str, segments: list[dict], gone: list[dict], version: int) -> dict[str, list[dict]]:
        """The table's parts after merging what there are ``FAN`` of, without marks that mean nothing any more."""
        while True:
            sizes: dict[int, list[dict]] = {}
            for s in segments:
                sizes.setdefault(int(math.log(max(s["bytes"] / SMALL, 1), FAN)), []).append(s)
            full = next((of for of in sizes.values() if len(of) >= FAN), None)
            if full is None:
                break
            segments = [s for s in segments if s not in full] + self._one(name, full, gone, version)
        oldest = min((s["at"] for s in segments), default=version)
        gone = [g for g in gone if g["at"] > oldest]
        if len(gone) >= FAN:
            marks = self.spark.read.schema(MARKS).parquet(*(f"{self.root}/{g['location']}" for g in gone))
            gone = self._write(marks.where(F.col("at") > oldest).groupBy("key").agg(F.max("at").alias("at")), "gone", version)
        return {"segments": segments, "gone": gone}

    def _one(self, name: str, segments: list[dict], gone: list[dict], version: int) -> list[dict]:
        """Segments written as one; no mark so far is about it."""
        rows = self.rows(name, segments, gone)
        return self._write(laid_out(rows) if name.endswith("_postings") else rows, f"tables/{name}", version)

    def _write(self, rows: DataFrame, folder: str, version: int) -> list[dict]:
        """The entry of a new part, or none where there are no rows."""
        location = f"{folder}/{version}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{location}")
        if self.spark.read.schema(rows.schema).parquet(f"{self.root}/{location}").isEmpty():
            files, path = self._at(location)
            files.delete(path, True)
            return []
        return [self._entry(location, version)]

    def _entry(self, location: str, version: int) -> dict:
        files, path = self._at(location)
        return {"location": location, "at": version, "bytes": files.getContentSummary(path).getLength()}

    def _at(self, name: str):
        """The file system, and the whole path of something of this index."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        return files, files.makeQualified(path)

    def _versions(self) -> list[int]:
        files, path = self._at("versions")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int) -> Snapshot:
        files, path = self._at(f"versions/{version:012d}.json")
        stream = files.open(path)
        try:
            found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(self, found["version"], found["layout"], found["tables"])

    def _commit(self, new: Snapshot) -> None:
        """Puts the version's file in place, if no other has come first."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        files, target = self._at(f"versions/{new.version:012d}.json")
        _, draft = self._at(f"versions/_{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps({"version": new.version, "layout": new.layout, "applied_at": time.time(), "tables": new.tables}).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, how)
        except Py4JJavaError as e:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise ConflictError(f"version {new.version} is there already") from e
            raise


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key has none."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
