"""Groups of texts by the similarity of their sets of word shingles, on top of SimHash.

At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, at which triangle bounds prune
nothing, so the vantage-point tree links what is within few bits, and an exact prefix join finds the
rest.  Shingles have an order: those of fewer texts first, and frequent ones, which a bitmap of fixed
size names, last.  Two sets of similarity ``s`` share one of the first ``n - ceil(s * n) + 1`` of each;
a text's own shingles, which no other has, need no partner, so that only texts made of others' shingles
have keys at all.  Texts that share a key are linked through the key's smallest text where that is
similar, and what this leaves in several components is compared block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SET_BITS, bit_set, cut, id_bit, id_set, in_set, map_batches, salted_join, stored, text_bytes
from .simhash import bit_majority, components, near_edges, shingle_hashes

#: Bits by which fingerprints may differ in the tree.
TREE_RADIUS = 3
#: Shingles that a task deals out at a time, those of a bucket on average, and texts among those at a
#: time that make a shingle a frequent one.
DEALT, BUCKET, FREQUENT = 2_000_000, 1_500_000, 64
#: Texts of a block, when what is left of a group is compared block by block.
BLOCK = 512
#: Counts of a set's sketch; counts that don't fit are all taken as the largest.
SKETCH = 128
PLACE = np.uint64(SET_BITS - 1)


def keys_of(n: int, similarity: float) -> int:
    """How many of a set's first shingles a similar set must share one of."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def described(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, c1, c2, fp, n, frequent``: what a text is, the fingerprint of its set of shingles, and its size.

    Rows without an id name shingles that are frequent among those of a task.
    """

    def work(batches):
        import xxhash

        seen, held = [], 0

        def frequent():
            found, times = np.unique(np.concatenate(seen), return_counts=True)
            return found[times >= FREQUENT].view(np.int64)

        def rows(columns, frequent_of):
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(frequent_of, pa.list_(pa.int64()))], names=["doc_id", "c1", "c2", "fp", "n", "frequent"])

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, content = np.unique(shingle_hashes(text, words)), xxhash.xxh3_128_intdigest(b" ".join(text.lower().split()))
                fp = bit_majority(own) if len(own) else 0
                out.append((doc_id, (content >> 64) - (1 << 63), (content & (1 << 64) - 1) - (1 << 63), fp - (1 << 64) if fp >> 63 else fp, len(own)))
                seen.append(own)
                held += len(own)
                if held >= DEALT:
                    yield rows([[None]] * 5, [frequent()])
                    seen, held = [], 0
            if out:
                yield rows(list(zip(*out, strict=True)), [None] * len(out))
        if seen:
            yield rows([[None]] * 5, [frequent()])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_bytes(F.col("text"))), work, "doc_id long, c1 long, c2 long, fp long, n long, frequent array<long>")


def shared_shingles(docs: DataFrame, ids: DataFrame, frequent: np.ndarray, words: int, similarity: float, buckets: int) -> DataFrame:
    """``id, spare, shingle, texts``: of documents ``doc_id``, the shingles that others have, a row each.

    Of ``c`` shingles that aren't frequent, of which ``m`` are shared, the first ``spare + m`` of these
    are keys.  Frequent ones that are keys have no ``spare`` and no count of texts.  The number of rows
    doesn't depend on ``buckets``, which grow with the input.
    """
    spark = docs.sparkSession
    kept, common = spark.sparkContext.broadcast(id_set(ids)), spark.sparkContext.broadcast(frequent)

    def deal(batches):
        names, sets, spares, held = [], [], [], 0

        def flush():
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            to = (every % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            every, owner, to = every[order], owner[order], to[order]
            edges = np.searchsorted(to, np.arange(buckets + 1))
            ids, spare, out = np.array(names, np.int64), np.array(spares, np.int32), []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = owner[edges[k] : edges[k + 1]]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                counts = np.diff(first, append=len(own)).astype(np.uint32)
                out.append((k, ids[own[first]].tobytes(), spare[own[first]].tobytes(), counts.tobytes(), every[edges[k] : edges[k + 1]].tobytes()))
            return out

        def rows(out):
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "ids", "spares", "counts", "shingles"])

        for batch in batches:
            batch, direct = batch.filter(pa.array(in_set(kept.value, batch.column(2).to_numpy()))), []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.unique(shingle_hashes(text, words))
                often = in_set(common.value, (own & PLACE).astype(np.int64))
                rare, keys = own[~often], keys_of(len(own), similarity)
                if len(rare):
                    names.append(doc_id)
                    sets.append(rare)
                    spares.append(keys - len(rare))
                    held += len(rare)
                first = own[often][: max(0, keys - len(rare))]
                if len(first):  # not dealt by shingle; the number only spreads such rows
                    direct.append((-1 - len(names) % buckets, np.int64(doc_id).tobytes(), b"", b"", first.tobytes()))
            if direct:
                yield rows(direct)
            if held >= DEALT:
                yield rows(flush())
                names, sets, spares, held = [], [], [], 0
        if sets:
            yield rows(flush())

    def count(key, group):
        if key[0].as_py() < 0:
            found = [np.frombuffer(x, np.int64) for x in group.column("shingles").to_pylist()]
            ids = np.repeat(np.frombuffer(b"".join(group.column("ids").to_pylist()), np.int64), [len(x) for x in found])
            return pa.table({"id": ids, "spare": pa.nulls(len(ids), pa.int32()), "shingle": np.concatenate(found), "texts": pa.nulls(len(ids), pa.int32())})
        whole = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        ids, spare, every = whole("ids", np.int64), whole("spares", np.int32), whole("shingles", np.uint64)
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), whole("counts", np.uint32))
        order = np.argsort(every)
        first = np.flatnonzero(np.diff(every[order], prepend=every[order[0]] ^ np.uint64(1)))
        times = np.empty(len(every), np.int32)
        times[order] = np.repeat(np.diff(first, append=len(every)), np.diff(first, append=len(every)))
        several = times > 1
        owner = owner[several]
        return pa.table({"id": ids[owner], "spare": spare[owner], "shingle": every[several].view(np.int64), "texts": times[several]})

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), text_bytes(F.col("text")), id_bit(F.col("doc_id")))
    dealt = map_batches(rows, deal, "bucket int, ids binary, spares binary, counts binary, shingles binary")
    return dealt.groupBy("bucket").applyInArrow(count, "id long, spare int, shingle long, texts int")


def meeting(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, id, rep, size``: texts ``id`` that share a key, once for keys of the same texts; ``rep`` is the smallest."""
    of = Window.partitionBy("id").orderBy(F.col("texts").asc_nulls_last(), "shingle")
    placed = shared.withColumn("place", F.row_number().over(of)).withColumn("m", F.count("texts").over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    keys = placed.where("spare IS NULL OR place <= spare + m").select("id", F.col("shingle").alias("key")).distinct()
    keys = stored(keys.join(texts.select("id"), "id", "left_semi"))
    groups = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("rep"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y")).where("size > 1")
    some = groups.groupBy("size", "rep", "x", "y").agg(F.min("key").alias("key")).select("key", "rep", "size")
    return stored(salted_join(keys, some, ["key"], ["id"]))


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``doc_id, own``: the sorted distinct shingle hashes of the documents ``doc_id``, stored."""
    kept = docs.sparkSession.sparkContext.broadcast(id_set(ids))

    def work(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_set(kept.value, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "own"])

    rows = map_batches(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), text_bytes(F.col("text")), id_bit(F.col("doc_id"))), work, "doc_id long, own binary")
    return stored(rows.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are at least so similar (Jaccard)."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared)


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges ``a, b`` whose texts' sets of shingles are at least so similar (Jaccard); ``b`` may be in any number."""
    both = salted_join(edges, sets.select(F.col("doc_id").alias("b"), F.col("own").alias("y")), ["b"], ["a"]).join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("x")), "a").select("a", "b", "x", "y")

    def verify(batches):
        for batch in batches:
            good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_batches(both, verify, "a long, b long")


def sketch(own: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall to each of SKETCH numbers: sums of smaller counts bound what two sets share."""
    counts = np.bincount((own % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.full(SKETCH, 65535, np.uint16) if counts.max() > 65535 else counts.astype(np.uint16)


def could_be_alike(size: int, counts: np.ndarray, sizes: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the other sets may be so similar to a set, by sizes and sketches: never false for one that is."""
    shared = np.minimum(np.minimum(counts, others).sum(1, dtype=np.int64), np.minimum(size, sizes))
    return shared >= similarity * (size + sizes - shared)


def left_edges(members: DataFrame, named: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame | None:
    """``a, b``: similar texts of different components ``named`` that share a key; None where keys have one component each.

    They link all such pairs as the pairs themselves would.  A group's texts are dealt into blocks,
    those of a large component into blocks of its own, and every two blocks that aren't of one
    component are compared, all with all: exactly, where sizes and sketches allow it.
    """
    rows = stored(members.where("size > 2").join(named, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    pieces = cut(rows.groupBy("key", "component").agg(F.count("*").alias("m")))
    mixed = cut(pieces.groupBy("key").agg(F.count("*").alias("k"), F.ceil(F.sum(F.when(F.col("m") < block, F.col("m")).otherwise(0)) / block).alias("pool")).where("k > 1"))
    if mixed.isEmpty():
        return None
    before = Window.partitionBy("key").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    own = pieces.where(F.col("m") >= block).withColumn("blocks", F.ceil(F.col("m") / block)).withColumn("past", F.coalesce(F.sum("blocks").over(before), F.lit(0))).select("key", "component", "blocks", "past")
    every = mixed.join(own.groupBy("key").agg(F.sum("blocks").alias("blocks")), "key", "left").select("key", "pool", (F.col("pool") + F.coalesce("blocks", F.lit(0))).alias("all"))
    # what a piece's texts need to know of their group, by piece: a group has any number of texts
    known = salted_join(pieces, every, ["key"], ["component"]).join(own, ["key", "component"], "left").drop("m")
    placed = salted_join(rows, known, ["key", "component"], ["id"])
    lone = F.col("blocks").isNull()
    lo, at = F.col("pool") + F.col("past"), F.xxhash64("id", "key")
    mine = F.when(lone, F.pmod(at, F.col("pool"))).otherwise(lo + F.pmod(at, F.col("blocks"))).cast("long")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda j: lone | (j < lo) | (j >= lo + F.col("blocks")))
    met = placed.withColumn("mine", mine).withColumn("other", F.explode(others)).select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "component")

    def work(key, group):
        first, same = key[1].as_py(), key[1].as_py() == key[2].as_py()
        ids, label = group.column("id").to_numpy(), group.column("component").to_numpy().copy()
        owns = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        lengths, counts = np.fromiter(map(len, owns), np.int64, len(owns)), np.stack([sketch(x) for x in owns])
        left = np.flatnonzero(group.column("mine").to_numpy() == first)
        right = left if same else np.flatnonzero(group.column("mine").to_numpy() != first)
        found = []
        for n, x in enumerate(left.tolist()):
            y = right[n + 1 :] if same else right
            y = y[label[y] != label[x]]
            y = y[could_be_alike(lengths[x], counts[x], lengths[y], counts[y], similarity)]
            for z in y.tolist():
                if label[z] != label[x] and alike(owns[x], owns[z], similarity):
                    found.append((ids[x], ids[z]))
                    label[label == label[z]] = label[x]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return met.join(sets.withColumnRenamed("doc_id", "id"), "id").groupBy("key", "i", "j").applyInArrow(work, "a long, b long")


def first_texts(docs: DataFrame, several: DataFrame) -> DataFrame:
    """``doc_id, text`` with one text of the ids ``several``, that of the smallest hash."""
    mark = F.xxhash64("text", F.lit(1))
    own = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(mark.alias("mark"), F.col("text"))).alias("t")).select("doc_id", "t.text")
    return cut(docs.join(several, "doc_id", "left_anti").unionByName(own))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, component_id``: groups of texts that are linked by a similarity (Jaccard) of their sets of shingles.

    All pairs of at least that similarity are linked, whatever their size and number; a text of fewer
    words than a shingle is one shingle.  Equal texts (words in lower case) are one from the start, and
    texts without words are equal.  Rows without an id are left out.  Rows that repeat an id are one
    document; if their texts differ, that of the smallest hash counts.  An empty table has no groups;
    other columns play no part.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    prints = stored(described(docs, words))
    content = F.struct("c1", "c2")
    several = cut(prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(content).alias("x"), F.max(content).alias("y")).where("x <> y").select("doc_id"))
    if not several.isEmpty():
        docs = first_texts(docs, several)
        prints = stored(described(docs, words))
    frequent = bit_set(prints.select(F.explode("frequent").alias("h")).select(F.pmod("h", F.lit(SET_BITS)).alias("bit")).distinct())
    prints = prints.where("doc_id IS NOT NULL")
    texts = stored(prints.groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("n").alias("n")))
    tree = near_edges(cut(texts.groupBy("fp").agg(F.min("id").alias("id"))), TREE_RADIUS)
    buckets = 1 + texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BUCKET
    shared = shared_shingles(docs, texts.select(F.col("id").alias("doc_id")), frequent, words, similarity, buckets)
    members = meeting(shared, texts)
    pair = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = stored(pair(tree).unionByName(members.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")).distinct())
    sets = shingle_sets(docs, edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), words)
    good = stored(similar(edges, sets, similarity))
    named = components(good)
    left = left_edges(members, named, sets, similarity)
    if left is not None:
        named = components(good.unionByName(left))
    groups = texts.join(named, "id", "left").select("c1", "c2", F.coalesce("component", "id").alias("component_id"))
    return salted_join(prints.select("doc_id", "c1", "c2"), groups, ["c1", "c2"], ["doc_id"]).select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows, with all their columns, of one document of each group of ``similar_groups``: that of
    the smallest id.  Rows without an id all stay, and so do all rows of an id that stays."""
    gone = similar_groups(docs, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
