"""Tables of an index.  Bodies are apart from the rest, so that scans of metadata never read them."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

#: Version of the layout below; it rises with every change of it.
LAYOUT = 2


def _table(*columns: tuple) -> StructType:
    return StructType([StructField(name, kind, null[0] if null else True) for name, kind, *null in columns])


FILES = _table(("path", StringType(), False), ("length", LongType()), ("modified_at", StringType()), ("content", BinaryType()))
DOCUMENTS = _table(
    ("document_id", StringType(), False), ("file_size", LongType()), ("text_bytes", LongType()), ("index_tier", StringType()), ("index_status", StringType()), ("demotion_reason", StringType()),
    ("drm_status", StringType()), ("retry_count", IntegerType()), ("last_attempt_at", TimestampType()), ("content_stored", IntegerType()), ("indexed_at", TimestampType()),
)
PATHS = _table(("path", StringType(), False), ("document_id", StringType()), ("filename", StringType()), ("extension", StringType()), ("modified_at", StringType()), ("seen_at", TimestampType()))
BODIES = _table(("document_id", StringType(), False), ("body", StringType()))
CONTENT = _table(("document_id", StringType(), False), ("body", StringType()), ("morph", StringType()), ("morph_kiwi", StringType()))
POSTINGS = _table(("term", StringType(), False), ("field", StringType()), ("key", StringType()), ("tf", IntegerType()), ("positions", ArrayType(IntegerType())))
KEY_STATS = _table(("key", StringType(), False), ("n_tokens", LongType()))
HITS = _table(("path", StringType()), ("filename", StringType()), ("snippet", StringType()), ("rank", DoubleType()), ("match_kind", StringType()))

#: Table names of a stored index.
TABLES = {
    "documents": DOCUMENTS, "paths": PATHS, "document_bodies": BODIES, "content_postings": POSTINGS, "content_stats": KEY_STATS, "filename_postings": POSTINGS, "filename_stats": KEY_STATS,
}
#: The key by which a table's rows are replaced and go.
KEYS = {
    "documents": "document_id", "paths": "path", "document_bodies": "document_id", "content_postings": "key", "content_stats": "key", "filename_postings": "key", "filename_stats": "key",
}

TIERS = ("FULL", "META", "SKIP")
#: Weights of the content fields in ranking.
FIELD_WEIGHTS = {"body": 1.0, "morph": 0.3, "morph_kiwi": 0.5}
