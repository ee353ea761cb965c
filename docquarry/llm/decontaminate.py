"""Benchmark decontamination (DataFrame functions only).

A document's shingles that any item of a size has are counted over every window of that size, wherever
they are in the item; windows with too few of them to be similar are left out, exactly.  Each other
window gets a SimHash, a multi-index of Hamming blocks finds every item of that size within the radius,
and the exact similarity of weighted shingles decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, cut, table, with_words

SHINGLE, SIMILARITY = 5, 0.8
#: Widths of the blocks of a fingerprint, and flips looked up in each.  Two fingerprints that differ
#: in at most ``RADIUS`` bits differ in at most ``FLIPS`` bits of some block.
BLOCKS, FLIPS = (13, 13, 13, 13, 12), 3
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
#: Shingles of all items, and keys of their index, up to which these are broadcast (under 100 MB);
#: beyond, documents' shingles and windows are shuffled to them.
BROADCAST_SHINGLES, BROADCAST_KEYS = 500_000, 1_000_000
#: Documents and sizes with windows, up to which their ids are broadcast.
BROADCAST_WINDOWED = 500_000


def with_shingles(df: DataFrame, words: int = SHINGLE) -> DataFrame:
    """Adds ``shingles``: 64-bit hashes of every run of five words (none in shorter texts)."""
    df = with_words(df).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    places = F.sequence(F.lit(0), F.size("hashes") - words)
    at = lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(words)))
    return df.withColumn("shingles", F.when(F.size("hashes") >= words, F.transform(places, at)).otherwise(F.array().cast("array<long>"))).drop("words", "norm", "hashes")


#: Shingles counted in one sum of three lanes; longer windows are counted in several.
LANE = (1 << 20) - 1


def simhash(shingles: Column) -> Column:
    """Bits set in over half the shingle hashes, repeats included.

    Three bits at a time are counted in three lanes of 20 bits of one sum; parts of at most ``LANE``
    shingles are counted by themselves, so that no lane overflows.
    """
    spread = lambda h, k: (F.shiftrightunsigned(h, 3 * k).bitwiseAND(F.lit(7)) * F.lit(1 | 1 << 19 | 1 << 38)).bitwiseAND(F.lit(1 | 1 << 20 | 1 << 40))
    total = lambda of, k: F.aggregate(of, F.lit(0).cast("long"), lambda acc, h: acc + spread(h, k))
    count = lambda lane, j: F.shiftrightunsigned(lane, 20 * j).bitwiseAND(F.lit(LANE))
    value = lambda most: sum((F.when(most(j), F.lit(1 << j)).otherwise(0) for j in (1, 2)), F.when(most(0), F.lit(1)).otherwise(0)).cast("long")
    short = F.transform(F.array(*(total(shingles, k) for k in range(22))), lambda lane: value(lambda j: count(lane, j) * 2 > F.size(shingles)))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(shingles) - 1) / LANE).cast("int")), lambda i: F.slice(shingles, i * LANE + 1, F.lit(LANE)))
    sums = lambda k: F.transform(parts, lambda p: total(p, k))
    several = lambda lanes, j: F.aggregate(lanes, F.lit(0).cast("long"), lambda acc, lane: acc + count(lane, j)) * 2 > F.size(shingles)
    long = F.transform(F.array(*map(sums, range(22))), lambda lanes: value(lambda j: several(lanes, j)))
    joined = lambda bits: F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda acc, n: F.shiftleft(acc, 3).bitwiseOR(n))
    return F.when(F.size(shingles) <= LANE, joined(short)).otherwise(joined(long))


def blocks(fp: Column) -> list[tuple[Column, int]]:
    """The blocks of a fingerprint and their widths."""
    out, at = [], 0
    for width in BLOCKS:
        out.append((F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)), width))
        at += width
    return out


def counted(shingles: Column) -> Column:
    """The shingles, told apart by how often each came before: sets of these measure as multisets.

    Once sorted, equal ones are runs, and each is numbered by its place in its run.
    """

    def numbered(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda at: lambda a, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(at, k + 1), F.size(s)) - a - 1), lambda n: F.xxhash64(F.get(s, a), n))
        return bound(begins, lambda at: F.flatten(F.transform(at, run(at))))

    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(bound(F.array_sort(shingles), numbered))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, start_word, similarity`` of every document and item that it holds.

    Similarity is that of weighted shingles, sum of smaller over sum of larger counts, between the
    item and the best window of its size (the first among equals); ``start_word`` is the window's
    first word.  Words are compared in lower case without punctuation.  Items of under five words and
    null items hold nothing; neither do null texts and those of under five words.  Repeated items count
    once each id; rows that repeat an id are one document, which holds what any of them does.  Texts and
    items of any length count whole; of an empty table there are no rows; other columns play no part.
    """
    items = cut(with_shingles(benchmark.where("item_id IS NOT NULL").select("item_id", "text")).select("item_id", "shingles").distinct()).where(F.size("shingles") > 0)
    items = cut(items.select("item_id", F.size("shingles").alias("n"), "shingles", simhash(F.col("shingles")).alias("item_fp"), counted(F.col("shingles")).alias("item")))
    seeds = items.select("n", F.explode("shingles").alias("shingle")).distinct()
    texts = with_shingles(docs.select("doc_id", "text")).select("doc_id", "shingles")
    # rows that repeat an id are told apart by what they hold
    mark = F.xxhash64("shingles").alias("mark")
    # outer, as the filter that Spark would else infer repeats the whole expression in its own lambda
    spots = texts.select("doc_id", mark, F.size("shingles").alias("size"), F.posexplode_outer("shingles").alias("pos", "shingle"))
    few_seeds = seeds.count() <= BROADCAST_SHINGLES
    hits = spots.join(F.broadcast(seeds), "shingle") if few_seeds else spots.where("shingle IS NOT NULL").join(seeds.hint("merge"), "shingle")
    places = hits.groupBy("doc_id", "mark", "size", "n").agg(F.array_sort(F.collect_set("pos")).alias("at"))  # a document's own places
    least = F.ceil(similarity * (F.col("n") + F.least("n", "size")) / (1 + similarity) - 1e-6).cast("int")
    last = F.greatest(F.col("size") - F.col("n"), F.lit(0))
    # `least` hits in a row that fit in a window: every start at which it holds them all
    runs = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("at") - F.col("least")), lambda i: F.struct(F.greatest(F.get("at", i + F.col("least") - 1) - F.col("n") + 1, F.lit(0)).alias("a"), F.least(F.get("at", i), F.col("last")).alias("b"))),
        lambda r: r["a"] <= r["b"],
    )
    starts = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["a"], r["b"]))))
    dense = places.withColumn("least", F.greatest(least, F.lit(1))).withColumn("last", last).where(F.size("at") >= F.col("least"))
    laid = cut(dense.select("doc_id", "mark", "n", starts.alias("starts")).where(F.size("starts") > 0))
    few_laid = laid.count() <= BROADCAST_WINDOWED
    holders = laid.select(F.col("doc_id").alias("id")).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(holders) if few_laid else holders, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    again = with_shingles(some).select(F.col("doc_id").alias("id"), "shingles", mark.alias("its"))
    windows = laid.join(again, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("its"))).select("doc_id", "n", "shingles", F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "n", "start", F.slice("shingles", F.col("start") + 1, F.col("n")).alias("window"))
    # cut, so that no fingerprint is computed before equal windows of a document are one
    windows = cut(windows.distinct()).withColumn("fp", simhash(F.col("window")))
    masks = {w: [sum(1 << b for b in c) for k in range(FLIPS + 1) for c in combinations(range(w), k)] for w in set(BLOCKS)}
    near = lambda block, width: F.transform(F.array(*map(F.lit, masks[width])), lambda m: block.bitwiseXOR(m.cast("long")))
    index = items.select("item_id", "n", "item_fp", F.posexplode(F.array(*(near(b, w) for b, w in blocks(F.col("item_fp"))))).alias("block", "keys")).select("item_id", "n", "item_fp", "block", F.explode("keys").alias("key"))
    few = items.count() * sum(len(masks[w]) for w in BLOCKS) <= BROADCAST_KEYS
    sized = lambda df: F.broadcast(df) if few else df.hint("merge")
    looked_up = windows.select("*", F.posexplode(F.array(*(b for b, _ in blocks(F.col("fp"))))).alias("block", "key"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # a window and an item may meet in several blocks: they count where they first do
    mixed = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*(F.when(F.bit_count(b) <= FLIPS, F.lit(k)) for k, (b, _) in enumerate(blocks(mixed)))) == F.col("block")
    found = looked_up.join(sized(index), ["n", "block", "key"]).where((apart <= RADIUS) & first).select("doc_id", "start", "window", "item_id")
    both = F.size(F.array_intersect("item", counted(F.col("window"))))
    share = both / (F.size("item") + F.size("window") - both)
    scored = found.join(sized(items.select("item_id", "item")), "item_id").withColumn("similarity", share).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").cast("long").alias("start_word"), (-F.col("best.s")).alias("similarity"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows, with all their columns, of documents that hold no item.

    A row without an id goes if any of these holds one, as they can't be told apart.
    """
    bad = contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(norm, ' ') AS w FROM (
    SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS norm FROM documents) WHERE norm <> ''
), b AS (
  SELECT item_id, string_split(norm, ' ') AS w FROM (
    SELECT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS norm FROM benchmark) WHERE norm <> ''
), ds AS (
  SELECT doc_id, len(w) - 4 AS size, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), bs AS (
  SELECT item_id, len(w) - 4 AS n, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)
), sizes AS (
  SELECT DISTINCT doc_id, item_id, size, n FROM ds JOIN bs USING (s)
), windows AS (
  SELECT doc_id, item_id, n, unnest(range(0, greatest(size - n, 0) + 1)) AS start FROM sizes
), wc AS (
  SELECT v.doc_id, v.item_id, v.start, ds.s, count(*) AS c FROM windows v
  JOIN ds ON ds.doc_id = v.doc_id AND ds.pos >= v.start AND ds.pos < v.start + v.n GROUP BY ALL
), ic AS (
  SELECT item_id, any_value(n) AS n, s, count(*) AS c FROM bs GROUP BY item_id, s
), scored AS (
  SELECT wc.doc_id, wc.item_id, wc.start, sum(least(wc.c, ic.c)) AS shared, any_value(ic.n) AS n FROM wc JOIN ic USING (item_id, s) GROUP BY ALL
), sized AS (
  SELECT doc_id, item_id, start, sum(c) AS size FROM wc GROUP BY ALL
), share AS (
  SELECT doc_id, item_id, start, shared::DOUBLE / (n + size - shared)::DOUBLE AS similarity FROM scored JOIN sized USING (doc_id, item_id, start)
)
SELECT doc_id, item_id, arg_min(start, {'s': -similarity, 'p': start})::BIGINT AS start_word, max(similarity) AS similarity
FROM share WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
