"""Files into an index: admission, identity, extraction once per content, postings; and removal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..errors import ConflictError
from ..functions.morph import Morphology, with_morph_field
from ..functions.text import bigram_text
from ..schema import FIELD_WEIGHTS
from ..sources.extract import Extractor, with_bodies
from ..sources.scan import canonical, scan_folder
from . import postings
from .admission import admit
from .store import Change, IndexStore, upserted

FIELDS = list(FIELD_WEIGHTS)


@dataclass(frozen=True)
class Outcome:
    """How many paths went which way."""

    full: int = 0
    meta: int = 0
    skip: int = 0


def identified(files: DataFrame) -> DataFrame:
    """Adds ``document_id``, the SHA-256 of a file's bytes in lower-case hex."""
    return files.withColumn("document_id", F.sha2("content", 256))


def first_of_each(files: DataFrame) -> DataFrame:
    """One file of each content, that of the smallest path.

    One aggregation, so that contents are read once and copies fall together within each task first.
    """
    rest = [c for c in files.columns if c not in ("document_id", "path")]
    return files.groupBy("document_id").agg(F.min(F.struct("path", *rest)).alias("f")).select("document_id", "f.*")


def document_rows(extracted: DataFrame, *more: str) -> DataFrame:
    """Rows of ``documents`` from extracted files, and ``more`` of their columns: any error makes a document metadata-only."""
    failed = F.col("error").isNotNull()
    return extracted.select(
        *more,
        "document_id", F.col("length").alias("file_size"), F.when(failed, 0).otherwise(F.octet_length("body")).cast("long").alias("text_bytes"),
        F.when(failed, "META").otherwise("FULL").alias("index_tier"), F.when(failed, "META_INDEXED").otherwise("INDEXED").alias("index_status"),
        F.when(failed, "PARSE_FAIL").alias("demotion_reason"), F.lit(None).cast("string").alias("drm_status"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("timestamp").alias("last_attempt_at"), F.lit(1).alias("content_stored"), F.current_timestamp().alias("indexed_at"),
    )


def content_fields(bodies: DataFrame, morphology: Callable[[], Morphology] | None = None) -> DataFrame:
    """``document_id, body, morph, morph_kiwi``: the text, the tokens of its bigrams, and its content words."""
    return with_morph_field(bodies.select("document_id", "body").withColumn("morph", bigram_text(F.col("body"))), morphology)


def tally(paths: DataFrame) -> DataFrame:
    """One row ``full, meta, skip`` from paths with ``outcome``."""
    return paths.agg(*(F.count_if(F.col("outcome") == t).alias(t.lower()) for t in ("FULL", "META", "SKIP")))


class Indexer:
    """Keeps an ``IndexStore`` up to date with files."""

    def __init__(self, spark: SparkSession, store: IndexStore, config: Config = Config(), extractors: dict[str, Extractor] | None = None, morphology: Callable[[], Morphology] | None = None):
        self.spark, self.store, self.config, self.extractors, self.morphology = spark, store, config, extractors, morphology

    def index_directory(self, root: str, prune_missing: bool = False, force: bool = False) -> Outcome:
        """All files below a folder.  Paths that are gone stay unless ``prune_missing``."""
        files = scan_folder(self.spark, root, max_length=self.config.max_bytes)
        outcome = self.index_files(files, force)
        if prune_missing:
            below = self.store.read("paths").where(F.col("path").startswith(canonical(root) + "/"))
            self.remove_paths(below.join(files.select("path"), "path", "left_anti").select("path"))
        return outcome

    def index_document(self, path: str) -> Outcome:
        from ..schema import FILES
        from ..sources.scan import file_row

        row = file_row(canonical(path), True)
        return self.index_files(self.spark.createDataFrame([row] if row else [], FILES))

    def index_files(self, files: DataFrame, force: bool = False) -> Outcome:
        """Files ``path, length, modified_at, content``; those skipped leave no trace.

        Content that is known is not extracted again, whatever tier it got, unless ``force``.
        A file whose content changed leaves its old document, which goes if no path has it any more.
        Only what is new or changed is written.
        """
        return _again(lambda: self._index_files(files, force))

    def _index_files(self, files: DataFrame, force: bool) -> Outcome:
        now, checked = self.store.snapshot(), admit(files, self.config)
        kept = identified(checked.where("skip_reason IS NULL AND content IS NOT NULL"))
        old, old_paths = now.read("documents"), now.read("paths")
        unknown = kept if force else kept.join(old.select("document_id"), "document_id", "left_anti")
        extracted = with_bodies(first_of_each(unknown).select("document_id", "path", "extension", "length", "content"), self.extractors)
        paths = kept.select("path", "document_id", "filename", "extension", "modified_at", F.current_timestamp().alias("seen_at")).dropDuplicates(["path"]).cache()
        known = old_paths.select("path", "document_id").join(paths.select("path"), "path", "left_semi").cache()
        fresh = extracted.join(paths.select("document_id"), "document_id", "left_semi").cache()
        try:
            read = fresh.where("error IS NULL")
            size = read.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
            tiers = upserted(old, document_rows(fresh), "document_id").select("document_id", "index_tier")
            done = checked.select("path", "skip_reason").join(paths.select("path", "document_id"), "path", "left").join(tiers, "document_id", "left")
            counts = tally(done.select(F.when(F.col("document_id").isNull(), "SKIP").otherwise(F.col("index_tier")).alias("outcome"))).first()
            left = known.join(paths, ["path", "document_id"], "left_anti").select("document_id").distinct()
            gone = orphans(left, upserted(old_paths, paths, "path"))
            if force:
                gone = gone.unionByName(fresh.select("document_id"))
            fields = content_fields(read, self.morphology)
            names = paths.join(known.select("path"), "path", "left_anti").select("path", "filename")  # a known path's name is indexed
            name_bytes = paths.agg(F.coalesce(F.sum(F.octet_length("path") + F.octet_length("filename")), F.lit(0))).first()[0]
            self.store.publish({
                "documents": Change(document_rows(fresh), gone), "paths": Change(paths, known.select("path")), "document_bodies": Change(read.select("document_id", "body"), gone),
                "content_postings": Change(postings.whole(fields, "document_id", FIELDS, size), gone),
                "content_stats": Change(lambda new: postings.sums(new["content_postings"], read.select("document_id")), gone),
                "filename_postings": Change(postings.whole(names, "path", ["filename"], name_bytes)), "filename_stats": Change(postings.key_stats(names, "path", ["filename"])),
            }, now)
        finally:
            for df in (fresh, paths, known):
                df.unpersist()
        return Outcome(counts["full"], counts["meta"], counts["skip"])

    def remove_paths(self, gone: DataFrame) -> None:
        """Takes out paths, and documents that no path has any more; unknown paths do nothing."""
        _again(lambda: self._remove_paths(gone))

    def _remove_paths(self, gone: DataFrame) -> None:
        now, names = self.store.snapshot(), gone.select("path").distinct()
        paths = now.read("paths")
        known = paths.select("path", "document_id").join(names, "path", "left_semi")
        without, last = known.select("path"), orphans(known.select("document_id").distinct(), paths.join(names, "path", "left_anti"))
        by_path, by_document = ("paths", "filename_postings", "filename_stats"), ("documents", "document_bodies", "content_postings", "content_stats")
        self.store.publish({n: Change(gone=without) for n in by_path} | {n: Change(gone=last) for n in by_document}, now)


def _again(work: Callable[[], Outcome | None], tries: int = 5) -> Outcome | None:
    """Does the work from the newest version, again where another writer came first."""
    for left in reversed(range(tries)):
        try:
            return work()
        except ConflictError:
            if not left:
                raise
    return None


def orphans(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """Documents that no path has."""
    return documents.join(paths.select("document_id"), "document_id", "left_anti")


def latest_paths(paths: DataFrame) -> DataFrame:
    """The newest path of each document (the smallest among equals)."""
    order = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("modified_at"), "path")
    return paths.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
