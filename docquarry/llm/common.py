"""What the operators of this package share: reading, folds, durable cuts and batches."""

from __future__ import annotations

import atexit
import contextlib
import string
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, as every contract of this package defines it.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch: at the longest texts seen (120 kB) a batch stays under 64 MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall in part 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null is empty.  Bytes cross to Python without being decoded."""
    return F.coalesce(text, F.lit("")).cast("binary")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors see.

    Only where ``spark.checkpoint.dir`` is unset and all work is done on one machine (``local`` masters,
    as in tests) one is made; elsewhere its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="docquarry-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it survives executors, and work before it isn't repeated."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in the same folder: smaller, and read column by column.

    It is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches small enough for very long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(work, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Labelled training documents ``(doc_id, text, y)``: those whose fold modulo 5 is not 0.

    At most about ``rows`` (a documented bound; the share is taken by a hash of the id, so that it
    doesn't depend on order), which is why the ids may be broadcast.  Where an id has several
    labels, the largest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select("doc_id", text_bytes(F.col("text")).alias("text")).join(F.broadcast(known), "doc_id")


ASCII_UPPER, ASCII_LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Bits of a broadcast set of documents that are looked at again (16 MB, whatever the corpus; where it
#: fills up, more documents are looked at).
SET_BITS = 1 << 27


def id_bit(doc_id: Column) -> Column:
    """The place of an id in such a set."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(SET_BITS))


def id_set(ids: DataFrame) -> np.ndarray:
    """Bits for the hashes of ``doc_id``: never false for one of them.  At most ``SET_BITS``."""
    return bit_set(ids.select(id_bit(F.col("doc_id")).alias("bit")))


def bit_set(rows: DataFrame) -> np.ndarray:
    """The set of the places ``bit``, each below ``SET_BITS``."""
    bit = F.col("bit") + 1  # the bitmap functions count from 1
    parts = rows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    size = 4096
    out = np.zeros(SET_BITS // 8, np.uint8)
    for r in parts:
        out[(r["bucket"] - 1) * size : r["bucket"] * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def in_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places are in the set."""
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


#: Parts that the rows of one key are dealt into where a key may have any number of rows.
SALTS = 16


def salted_join(rows: DataFrame, one: DataFrame, on: list[str], by: list[str], salts: int = SALTS) -> DataFrame:
    """``rows`` joined to ``one``, which has one row a key, with the rows of a key dealt out by a hash of ``by``.

    Each row of ``one`` goes only to the salts that its key has, so that unique keys cost one row.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    spread = dealt.select(*on, "__salt").distinct().join(one, on)
    return dealt.join(spread, [*on, "__salt"]).drop("__salt")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


#: What stands between words of licence and benchmark texts: ASCII that is no letter or digit.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_words(df: DataFrame, text: str = "text", words: str = "words", norm: str = "norm") -> DataFrame:
    """Adds the text's words in lower case as an array, and joined by single spaces as ``norm``.

    Lower-casing other letters than A-Z too makes no difference to where words begin and end.
    """
    df = df.withColumn(norm, F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN_WORDS, " ")))
    return df.withColumn(words, F.when(F.col(norm) == "", F.array().cast("array<string>")).otherwise(F.split(norm, " ")))
