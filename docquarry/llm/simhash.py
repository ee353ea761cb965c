"""SimHash near-deduplication: a vantage-point tree over fingerprints, dealt out as shards.

A node of the tree has a vantage point ``v`` and a radius ``m``; a fingerprint at distance below
``m`` lives left of it, any other right.  Two fingerprints within ``r`` of each other either live on
the same side, or the right one is at distance below ``m + r``: by the triangle inequality it is
enough to send those right ones to the left side as *visitors*, and to let a visitor go on into
every side whose bound it reaches.  Every pair within ``r`` meets in one shard, exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, salted_join, table, text_bytes

#: Fingerprints that live in one shard, on average; one of over OVERFULL times as many is split on.
SHARD, OVERFULL = 4096, 4
#: Fingerprints looked at (about) to choose vantage points and radii.  It shapes the tree, not the result.
TREE_SAMPLE = 2048
#: Neighbours of a vertex beyond which edges are dealt out.
HUB = 100_000
LANES = np.uint64(0x0101010101010101)


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half the hashes."""
    counts = np.empty((8, 8), np.int64)
    blocks = np.arange(0, len(hashes), 255)
    for k in range(8):
        sums = np.add.reduceat(hashes >> np.uint64(k) & LANES, blocks)
        counts[:, k] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits((counts.ravel() * 2 > len(hashes)), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included; of all its words if these are few."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 42)], np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def simhash(text: bytes, words: int) -> int:
    """Fingerprint of a text's word shingles; 0 without words."""
    hashes = shingle_hashes(text, words)
    return bit_majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long)."""

    def work(batches):
        for batch in batches:
            fp = np.array([simhash(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_bytes(F.col("text"))), work, "doc_id long, fp long")


def deal(points: DataFrame, levels: list[tuple[int, int]], radius: int) -> DataFrame:
    """Where the points live and visit below the root: ``fp, id, leaf, home``."""

    def work(batches):
        for batch in batches:
            fp, ids = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            row, leaf, home = np.arange(len(fp)), np.ones(len(fp), np.int64), np.ones(len(fp), bool)
            for v, m in levels:
                d = np.bitwise_count(fp[row] ^ np.uint64(v)).astype(np.int64)
                left = np.where(home, d < m, d < m + radius)
                right = np.where(home, d >= m, d >= m - radius)
                visit = home & ~left & (d < m + radius)
                row = np.concatenate([row[left], row[right], row[visit]])
                leaf, home = np.concatenate([leaf[left] * 2, leaf[right] * 2 + 1, leaf[visit] * 2]), np.concatenate([home[left], home[right], np.zeros(visit.sum(), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(fp[row].view(np.int64)), pa.array(ids[row]), pa.array(leaf), pa.array(home)], names=["fp", "id", "leaf", "home"])

    return map_batches(points.select("fp", "id"), work, "fp long, id long, leaf long, home boolean")


def split_on(dealt: DataFrame, most: int, radius: int) -> DataFrame | None:
    """One more level below the shards in which over ``most`` live; None if there are none."""
    full = cut(dealt.where("home").groupBy("leaf").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", "leaf")).alias("v")).where(F.col("n") > most))
    if full.isEmpty():
        return None
    lives = dealt.where("home").join(full, "leaf").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))))
    # the vantage point itself is at distance 0, all others farther: a radius of 1 or more always splits
    nodes = lives.groupBy("leaf").agg(F.first("v").alias("v"), F.greatest(F.percentile_approx("d", 0.5), F.lit(1)).alias("m"))
    d, m, home = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))), F.col("m"), F.col("home")
    side = lambda leaf, lives: F.struct(leaf.alias("leaf"), lives.alias("home"))
    left, right, same = F.col("leaf") * 2, F.col("leaf") * 2 + 1, F.array(side(F.col("leaf"), home))
    to = F.when(m.isNull(), same).otherwise(F.filter(F.array(
        F.when(F.when(home, d < m).otherwise(d < m + radius), side(left, home)),
        F.when(F.when(home, d >= m).otherwise(d >= m - radius), side(right, home)),
        F.when(home & (d >= m) & (d < m + radius), side(left, F.lit(False))),
    ), lambda x: x.isNotNull()))
    return dealt.join(nodes, "leaf", "left").select("fp", "id", F.explode(to).alias("to")).select("fp", "id", "to.leaf", "to.home")


def links(lives: np.ndarray, visits: np.ndarray, radius: int, among: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within ``radius``: indexes, visitors after those that live here."""
    if not len(lives):
        return []
    every = np.concatenate([lives, visits])
    label, out = np.arange(len(every)), []
    for at in range(0 if among else len(lives), len(every), 256):
        block = every[at : at + 256]
        near = np.bitwise_count(block[:, None] ^ lives[None, :]) <= radius
        near[np.arange(len(block)), np.minimum(np.arange(at, at + len(block)), len(lives) - 1)] &= np.arange(at, at + len(block)) >= len(lives)
        for i in np.flatnonzero(near.any(1)):
            found = np.flatnonzero(near[i])
            sets, first = np.unique(label[found], return_index=True)
            joins = found[first[sets != label[at + i]]]
            if len(joins):
                out += [(at + int(i), int(x)) for x in joins]
                sets = np.append(sets, label[at + i])
                label[np.isin(label, sets)] = sets.min()
    return out


def near_edges(points: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """``a, b``: ids that link all distinct fingerprints within ``radius`` as their pairs would.

    ``points`` are ``fp, id`` with distinct fingerprints.  Shards are bounded: overfull ones are
    split by vantage points of their own, and visitors are dealt to copies of a shard.
    """
    n = points.count()
    share = int((1 << 40) * min(1.0, TREE_SAMPLE / max(1, n)))
    sample = np.array(sorted(r["fp"] for r in points.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 40)) < share).collect()), np.int64).view(np.uint64)
    levels = []
    for v in np.random.default_rng(1).permutation(sample)[: max(0, math.ceil(math.log2(max(1, n / shard))))]:
        levels.append((int(v), max(1, int(np.median(np.bitwise_count(sample ^ v))))))
    dealt = cut(deal(points, levels, radius))
    while (deeper := split_on(dealt, OVERFULL * shard, radius)) is not None:
        dealt = cut(deeper)
    copies = dealt.groupBy("leaf").agg(F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("home")) / (2 * OVERFULL * shard)).cast("int")).alias("copies"))
    parts = dealt.join(copies, "leaf").select(
        "fp", "id", "leaf", "home",
        F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("copies")).cast("int")))).alias("copy"),
    )

    def work(key, group):
        home = group.column("home").to_numpy()
        fp, ids = group.column("fp").to_numpy().view(np.uint64), group.column("id").to_numpy()
        ids = np.concatenate([ids[home], ids[~home]])
        found = links(fp[home], fp[~home], radius, key[1].as_py() == 0)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return parts.groupBy("leaf", "copy").applyInArrow(work, "a long, b long")


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """``id, component`` (its smallest id) of every other id that an edge names, by alternating stars.

    Each round replaces edges by edges to a vertex's smallest neighbour, as aggregations and joins
    on the vertex; it ends when a round changes nothing, after about log(n) rounds.  Once a vertex has
    over ``hub`` neighbours, the edges of every vertex are dealt out for these joins.
    """
    a, b = F.col("a"), F.col("b")
    edges, before = cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()), None
    while True:
        by_star = edges.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
        *seen, most = by_star.agg(F.sum("n"), F.sum("s"), F.max("n")).first()
        if seen == before:
            return edges.select(a.alias("id"), b.alias("component"))
        before = seen
        with_least = lambda rows, least: salted_join(rows, least, ["a"], ["b"]) if (most or 0) > hub else rows.join(least, "a")  # noqa: B023, E731
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = with_least(both, least).where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = with_least(large, least)
        edges = cut(joined.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (hex) and ``component_id``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits, and a component
    is named by its smallest ``doc_id``.  A text without words (null, empty or white space) has
    fingerprint zero and is linked like any other.  Repeated rows stay repeated.  A null id names no
    component: a fingerprint that only null ids have isn't linked, and its component is null.  Long
    texts count whole; an empty table gives no rows; other columns play no part.
    """
    prints = cut(fingerprints(docs, words))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(near_edges(points.where("id IS NOT NULL"), radius, shard))
    named = points.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return salted_join(prints, named, ["fp"], ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
