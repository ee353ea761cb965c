"""Line deduplication by a deletion-neighbourhood join, over words.

The symbols of the edit distance are words: a line of ``w`` words has the ``w`` variants that lack
one of them, and itself.  Lines that share a variant at the same place differ in one word there;
a line that is another's variant lacks one word of it.  Both are exactly the lines within one edit,
so no group of equal variants has pairs to be sorted out, and each line needs only its group's
earliest member: the work is linear however many lines share a variant.

Before variants are emitted, lines that can't have a partner are set aside, exactly: an edit leaves
a line's first half or its second half alone, so partners share the hash of a half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bit, id_set, in_set, map_batches, salted_join, stored, table, text_bytes

#: Lines of fewer words say too little to be called copies, and stay.
MIN_WORDS = 5
#: Lines of at least so many words may differ in one of them (similarity 0.9 or more).
NEAR_WORDS = 10
BASE = np.uint64(0x9E3779B97F4A7C15)


def line_words(line: bytes) -> list[bytes]:
    """What a line is compared by: its words between ASCII white space, A-Z in lower case."""
    return line.lower().split()


def line_key(words: list[bytes]) -> tuple[int, int]:
    """A line's 128-bit hash, as two signed longs."""
    import xxhash

    key = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63)


def halves(words: list[bytes]) -> list[int]:
    """Hashes of halves, as a line of its own length and as the longer of two that differ by one."""
    import xxhash

    out = []
    for n in (len(words), len(words) - 1):
        head, tail = words[: n // 2], words[len(words) - (n - n // 2) :]
        for side, part in ((b"<", head), (b">", tail)):
            out.append(xxhash.xxh64_intdigest(b"%d%s%s" % (n, side, b" ".join(part))) - (1 << 63))
    return out


def line_keys(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """``doc_id, line, words, k1, k2, halves`` of every line that is long enough."""

    def work(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, line in enumerate(text.split(b"\n")):
                    words = line_words(line)
                    if len(words) >= min_words:
                        rows.append((doc_id, n, len(words), *line_key(words), halves(words) if len(words) >= near_words else None))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "line", "words", "k1", "k2", "halves"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_bytes(F.col("text"))), work, "doc_id long, line int, words int, k1 long, k2 long, halves array<long>")


def variants(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the line without its i-th word, for every i, and of the line itself."""
    import xxhash

    h = np.fromiter((xxhash.xxh64_intdigest(w, 17) for w in words), np.uint64, len(words))
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h) - 1, BASE)]), dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)])
        return np.append(before[:-1] + (before[-1] - before[1:]) * inverse, before[-1])


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Edit distance of at most one word."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def line_contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, line, content`` for lines ``k1, k2, doc_id, line``; texts travel compressed."""
    kept = docs.sparkSession.sparkContext.broadcast(id_set(wanted.select("doc_id")))

    def shrink(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.filter(pa.array(in_set(kept.value, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "text"])

    def pick(batches):
        import zstandard

        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, text, picked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = opener.decompress(text).split(b"\n")
                for w in picked:
                    words = line_words(parts[w["line"]]) if w["line"] < len(parts) else []
                    if line_key(words) == (w["k1"], w["k2"]):  # not another text of the same id
                        out.append((w["k1"], w["k2"], doc_id, w["line"], b" ".join(words)))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["k1", "k2", "doc_id", "line", "content"])

    texts = map_batches(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), text_bytes(F.col("text")), id_bit(F.col("doc_id"))), shrink, "doc_id long, text binary")
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "k1", "k2")).alias("wanted"))  # a document's own lines
    return map_batches(texts.join(by_doc, "doc_id").select("doc_id", "text", "wanted"), pick, "k1 long, k2 long, doc_id long, line int, content binary").dropDuplicates(["k1", "k2"])


def near_earlier(places: DataFrame, lines: DataFrame, docs: DataFrame, near_words: int) -> DataFrame:
    """``k1, k2, near``: an earlier line (``doc_id, line``) within one edit of the distinct line.

    ``places`` are all lines with their hashes, ``lines`` the distinct ones with the earliest place
    of each, ``first``.
    """
    # distinct in each task first: a repeated line counts once, however often it is there
    sides = stored(places.where(F.col("words") >= near_words).select("k1", F.explode("halves").alias("half")).distinct())
    shared = sides.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("half")
    alive = salted_join(sides, shared, ["half"], ["k1"]).select("k1").distinct()
    wanted = stored(lines.join(alive, "k1", "left_semi").select("k1", "k2", "first.doc_id", "first.line"))
    contents = stored(line_contents(docs, wanted))

    def emit(batches):
        for batch in batches:
            for i, content in enumerate(batch.column(0).to_pylist()):
                found = variants(content.split(b" "))
                n = len(found)
                place = np.append(np.arange(n - 1), -1).astype(np.int32)
                size = np.full(n, n - 2, np.int32)
                size[-1] += 1
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(size), pa.array(place), pa.array(np.full(n, batch.column(1)[i].as_py()))], names=["variant", "size", "place", "k1"])

    # variants of few lines but of the same one again fall together in the first aggregation; a variant of
    # any number of lines is dealt out by lines wherever its rows are joined
    emitted = stored(map_batches(contents.select("content", "k1"), emit, "variant long, size int, place int, k1 long"))
    met = emitted.groupBy("variant", "size").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.max("place").alias("c")).where("a <> b").select("variant", "size")
    rows = stored(salted_join(emitted, met, ["variant", "size"], ["k1"]).join(wanted.select("k1", F.struct("doc_id", "line").alias("first")), "k1"))
    by_place = rows.groupBy("variant", "size", "place").agg(F.min("first").alias("least"))
    by_variant = by_place.groupBy("variant", "size").agg(
        F.min(F.when(F.col("place") < 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("least"))).alias("lacking")
    )
    found = by_place.join(by_variant, ["variant", "size"]).select(
        "variant", "size", "place", F.when(F.col("place") < 0, F.col("lacking")).otherwise(F.least("least", "whole")).alias("near")
    )
    pairs = salted_join(rows, found, ["variant", "size", "place"], ["k1"]).where(F.col("near") < F.col("first")).groupBy("k1").agg(F.min("near").alias("near"))
    mine = contents.select("k1", "k2", "content")
    other = contents.select(F.struct("doc_id", "line").alias("near"), F.col("content").alias("other"))

    def verify(batches):
        for batch in batches:
            good = [within_one(a.split(b" "), b.split(b" ")) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["k1", "k2", "near"]).filter(pa.array(good, pa.bool_()))

    checked = salted_join(pairs, other, ["near"], ["k1"]).join(mine, "k1").select("k1", "k2", "near", "content", "other")
    return map_batches(checked, verify, "k1 long, k2 long, near struct<doc_id: long, line: int>").distinct()


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """One row per line that repeats an earlier one: ``doc_id, line_no, keep_doc_id, keep_line_no, n_words, edits``.

    Earlier means a smaller ``(doc_id, line_no)``, lines counted from 0 at line feeds.  A line goes
    if an earlier one has the same words (``edits`` 0; A-Z in lower case, any white space), or, from
    ``near_words`` words, if an earlier one is within one word's edit (``edits`` 1), whether or not
    that one stays itself; ``keep_*`` names the earliest such line found.  Lines of under
    ``min_words`` words, empty ones among them, always stay.  Null texts have no such lines; rows
    without an id are left alone.  Rows that repeat an id are one document: of equal texts each line has
    one row in the result, of different texts each place has a row for every line there that goes.
    Lines and texts of any length count whole; an empty table has no rows; other columns play no part.
    """
    places = stored(line_keys(docs.where("doc_id IS NOT NULL"), min_words, near_words))
    place = F.struct("doc_id", "line").alias("place")
    lines = stored(places.select("k1", "k2", place).groupBy("k1", "k2").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    near = stored(near_earlier(places, lines, docs, near_words))
    repeated = stored(lines.join(near, ["k1", "k2"], "left").where(F.col("near").isNotNull() | (F.col("n") > 1)))
    every = places.select("k1", "k2", "doc_id", "line", "words")
    found = salted_join(every, repeated, ["k1", "k2"], ["doc_id"])
    exact = F.col("near").isNull()
    keep = F.when(exact, F.col("first")).otherwise(F.col("near"))
    return found.where(~exact | (F.struct("doc_id", "line") > F.col("first"))).select(
        "doc_id", F.col("line").cast("long").alias("line_no"), keep["doc_id"].alias("keep_doc_id"), keep["line"].cast("long").alias("keep_line_no"),
        F.col("words").cast("long").alias("n_words"), F.when(exact, 0).otherwise(1).cast("int").alias("edits"),
    ).distinct()


def without_duplicate_lines(docs: DataFrame, **how) -> DataFrame:
    """The same rows and columns without the lines that ``duplicate_lines`` names, and with all others.

    A text becomes empty only where every one of its lines goes.  ``n_chars``, where there is one,
    follows the text.  Rows without an id stay as they are.  Of rows that repeat an id with different
    texts, each loses the places that are named for the id.
    """
    named = duplicate_lines(docs, **how)
    gone = named.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("line_no").alias("lines"))  # a document's own lines
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # whatever the columns are called
    rows = docs.toDF(*names.values())
    doc_id, text = F.col(names["doc_id"]), F.col(names["text"])
    out = rows.join(gone, doc_id == F.col("id"), "left")
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains("lines", i.cast("long"))), "\n")
    out = out.withColumn(names["text"], F.when(F.col("lines").isNull(), text).otherwise(rest))
    if "n_chars" in names:
        n = F.col(names["n_chars"])
        out = out.withColumn(names["n_chars"], F.when(F.col("lines").isNull(), n).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(v).alias(c) for c, v in names.items()))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL
), lines AS (
  SELECT doc_id, i - 1 AS line_no,
         trim(regexp_replace(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)
), long_lines AS (
  SELECT DISTINCT doc_id, line_no, norm, string_split(norm, ' ') AS w FROM lines WHERE norm <> '' AND len(string_split(norm, ' ')) >= 5
), firsts AS (
  SELECT norm, any_value(w) AS w, min({'d': doc_id, 'l': line_no}) AS first FROM long_lines GROUP BY norm
), lacking AS (
  SELECT norm, first, i AS place, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 10)
), near AS (
  SELECT norm, min(other) AS near FROM (
    SELECT norm, first, min(first) OVER (PARTITION BY v, place) AS other FROM lacking
    UNION ALL
    SELECT l.norm, l.first, f.first FROM lacking l JOIN firsts f ON f.norm = l.v AND len(f.w) >= 10
    UNION ALL
    SELECT f.norm, f.first, l.first FROM lacking l JOIN firsts f ON f.norm = l.v AND len(f.w) >= 10
  ) WHERE other < first GROUP BY norm
)
SELECT a.doc_id AS doc_id, a.line_no AS line_no,
       CASE WHEN n.near IS NULL THEN f.first.d ELSE n.near.d END AS keep_doc_id,
       CASE WHEN n.near IS NULL THEN f.first.l ELSE n.near.l END AS keep_line_no,
       len(a.w) AS n_words, CASE WHEN n.near IS NULL THEN 0 ELSE 1 END::INTEGER AS edits
FROM long_lines a JOIN firsts f ON a.norm = f.norm LEFT JOIN near n ON a.norm = n.norm
WHERE n.near IS NOT NULL OR {'d': a.doc_id, 'l': a.line_no} > f.first
"""
