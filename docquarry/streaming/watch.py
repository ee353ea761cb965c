"""Keeping an index current from a stream of changes."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from ..operators.ingest import Indexer
from ..sources.changes import CREATE, DELETE, MODIFY, begin, watch_folder
from ..sources.scan import canonical, scan_files

INDEXED, REMOVED, IGNORED = "INDEXED", "REMOVED", "IGNORED"
DEBOUNCE_MS = 3000
#: How often the folder is looked at.
POLL = "500 milliseconds"
#: How long after its session an event may still arrive.
LATENESS = "10 minutes"


def relevant(changes: DataFrame) -> DataFrame:
    """Creations, removals and changes of content or name; reads and attributes don't count."""
    return changes.where(F.col("kind").isin(CREATE, MODIFY, DELETE))


def debounced(changes: DataFrame, gap: str, lateness: str = LATENESS) -> DataFrame:
    """``session_start, session_end, paths``: one global session that any path prolongs, the gap itself included.

    On a stream the watermark lets append mode close sessions.
    """
    if changes.isStreaming:
        rows = changes.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w")).agg(F.collect_set("path").alias("paths"))
        return rows.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "paths")
    return sessions(changes, gap).groupBy("session_start").agg(F.max("session_end").alias("session_end"), F.collect_set("path").alias("paths"))


#: Slots that one task puts in order together.
SLOTS = 4096


def sessions(changes: DataFrame, gap: str) -> DataFrame:
    """``session_start, path, session_end`` of a table's sessions: a row for each of their paths, with the end that this path gives.

    Time is cut into slots of the gap's length, which no session ends within, so a slot's first and last instants say
    whether one begins there.  Slots depend on nothing but the instants: what is read more than once gives the same.
    """
    step = F.expr(f"INTERVAL {gap}")
    if changes.schema["ts"].dataType == TimestampNTZType():  # no zone's clock changes are in its way
        seconds = F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
        micros = seconds * 1000000 + (F.expr("extract(SECOND FROM ts)") * 1000000).cast("long")
    else:
        micros = F.unix_micros("ts")
    timed = changes.where("ts IS NOT NULL").select("ts", "path", micros.alias("micros"), F.expr(f"greatest(unix_micros(timestamp_micros(0) + INTERVAL {gap}), 1L)").alias("width"))
    seen = timed.groupBy(F.expr("(micros - pmod(micros, width)) div width").alias("slot"), "path").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    slots = seen.groupBy("slot").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("part", F.floor(F.col("slot") / SLOTS))
    own, earlier = Window.partitionBy("part").orderBy("slot"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    ends = slots.groupBy("part").agg(F.max("last").alias("last")).select("part", F.max("last").over(earlier).alias("past"))
    before = F.coalesce(F.lag("last").over(own), "past")
    begun = slots.join(ends, "part").withColumn("begins", F.when(before.isNull() | (F.col("first") > before + step), F.col("first")))
    latest = begun.groupBy("part").agg(F.max("begins").alias("begin")).select("part", F.max("begin").over(earlier).alias("open"))
    starts = begun.withColumn("own", F.max("begins").over(own)).join(latest, "part").select("slot", F.coalesce("own", "open").alias("session_start"))
    return seen.join(starts, "slot").groupBy("session_start", "path").agg((F.max("last") + step).alias("session_end"))


def resolve(indexer: Indexer, paths: list[str]) -> dict[str, str]:
    """Brings the index to what the paths are now, whatever the events said: one merge, and one removal.

    Folders are ignored; so are skipped files, and paths that are gone and weren't known.
    """
    outcome: dict[str, str] = {}
    rows, gone = [], []
    for path in sorted({canonical(p) for p in paths}):
        if os.path.isdir(path):
            outcome[path] = IGNORED
        elif os.path.exists(path):
            rows.append(path)
        else:
            gone.append(path)
    spark, store = indexer.spark, indexer.store
    known = store.read("paths").select("path", "document_id")
    if rows:
        indexer.index_files(scan_files(spark, rows, indexer.config.max_bytes))  # contents are read by the tasks
        now = {r["path"] for r in store.read("paths").where(F.col("path").isin(rows)).select("path").collect()}  # of this batch's paths
        outcome |= {p: INDEXED if p in now else IGNORED for p in rows}
    if gone:
        had = {r["path"] for r in known.where(F.col("path").isin(gone)).select("path").collect()}
        if had:
            indexer.remove_paths(spark.createDataFrame([(p,) for p in sorted(had)], "path string"))
        outcome |= {p: REMOVED if p in had else IGNORED for p in gone}
    return outcome


def watch(indexer: Indexer, root: str, checkpoint: str, debounce_ms: int = DEBOUNCE_MS, on_batch: Callable[[dict[str, str]], None] = lambda outcome: None) -> StreamingQuery:
    """Indexes the folder, then follows it: a batch is what changed until all was quiet for the debounce.

    What the folder is is noted before it is indexed, and the stream starts from there: changes
    meanwhile are changes.  What comes and goes within the debounce is never indexed.  A batch that is
    replayed after a failure does the same again.
    """
    seen = f"{checkpoint}/seen"
    begin(seen, root)
    indexer.index_directory(root)
    changes = relevant(watch_folder(indexer.spark, root, seen, debounce_ms))

    def merge(batch: DataFrame, _: int) -> None:
        paths = {p for r in debounced(batch, f"{max(debounce_ms, 1)} milliseconds").collect() for p in r["paths"]}  # one trigger's changes
        if paths:
            on_batch(resolve(indexer, sorted(paths)))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/stream").trigger(processingTime=POLL).start()


def wait_for(condition: Callable[[], bool], seconds: float, pause: float = 0.2) -> bool:
    """Whether the condition came true in time."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if condition():
            return True
        time.sleep(pause)
    return condition()
