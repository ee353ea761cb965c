"""Exact deduplication with skew-safe combining (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, SPACE, cut, salted_join, table


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space becomes one space; null
    counts as empty.  Three combining steps, each of which groups by the digest *and* the full
    normalised text: within a task (the map-side part of the first aggregation), within a salt
    (its reduce side), and over the salts.  Only ids and digests then go back to the documents, the
    rows of one text dealt out by their ids.  Should two texts ever share a digest, the way back compares full texts as well.

    An input row whose id is the smallest of its group is kept, so repeated rows of that id all
    are.  A null id is never preferred; a group of null ids only has a null ``keep_id``.  An empty
    table gives no rows; texts of any length count whole; other columns play no part.
    """
    base = (
        docs.select(F.col(key).alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").alias("norm"))
        .withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    )
    merged = (
        base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    )
    groups = merged.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest = cut(
        groups.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    )
    if by_digest.where("texts > 1").isEmpty():
        found = salted_join(cut(base.select("doc_id", "digest")), by_digest.drop("texts"), ["digest"], ["doc_id"], salts)
    else:
        found = salted_join(base, groups, ["digest", "norm"], ["doc_id"], salts)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id AS doc_id, g.keep_id AS keep_id, g.group_size AS group_size,
       n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
