import random
from collections import Counter

import numpy as np
import xxhash

from docquarry.llm import similar, simhash


def fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def linked(prints, radius):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def test_components_like_all_pairs(documents, empty):
    rows = documents.where("doc_id IS NOT NULL").collect()
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    want = linked(prints, 2)
    got = simhash.near_duplicates(documents, shard=8).collect()
    assert len(got) == documents.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(empty).count() == 0


def test_tree_finds_every_pair(spark):
    """Clusters and random points, shards far too small, and one so tight that nothing can be pruned."""
    rng = random.Random(9)
    points = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        points |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(40)}
    points |= {1 << b for b in range(64)} | {0}
    prints = dict(enumerate(sorted(points)))
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "id long, fp long")
    for radius, shard in ((2, 8), (3, 20), (2, 4096)):
        want = linked(prints, radius)
        found = {r["id"]: r["component"] for r in simhash.components(simhash.near_edges(df, radius, shard)).collect()}
        assert {i: found.get(i, i) for i in prints} == want


def test_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r["component"] for r in simhash.components(edges).collect()} == {0}


def test_forest_is_small():
    lives = np.array([0, 1, 2, 3, 4, 5, 6, 7], np.uint64)
    found = simhash.links(lives, np.array([8], np.uint64), 2, True)
    assert len(found) == 8


def similar_groups(rows, least=0.8):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or len(a & b) >= least * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_similar_like_all_pairs(spark, documents, empty):
    """Edited copies, a group larger than is looked at whole, and odd rows."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = [(r["doc_id"], r["text"]) for r in documents.where("doc_id IS NOT NULL").select("doc_id", "text").distinct().collect()]
    at = 1000
    for copies in [2] * 30 + [120]:
        base = [word() for _ in range(rng.randrange(40, 200))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, len(base) // 45 + 1)):
                words[rng.randrange(len(words))] = word()
            rows.append((at, " ".join(words)))
            at += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs).collect()}
    assert got == similar_groups(sorted(rows))
    assert similar.similar_groups(empty).count() == 0


def test_stage_keeps_one_of_each(documents):
    kept = similar.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    names = similar_groups(sorted({(r["doc_id"], r["text"]) for r in documents.where("doc_id IS NOT NULL").collect()}, key=lambda x: x[0]))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in names.items() if i == c} | {None}


def test_large_group_of_pairs(spark):
    """Texts that all share the smallest shingles and are linked in pairs only."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared, rows = [word() for _ in range(45)], []
    for _ in range(400):
        own = [word() for _ in range(55)]
        rows += [(len(rows), " ".join(shared + own)), (len(rows) + 1, " ".join(shared + own[:-4] + [word() for _ in range(4)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs).collect()} == similar_groups(rows)


def test_blocks_of_large_components(spark):
    """A component of several blocks, whose last member is found by one of its texts only."""
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(100)]
    rows += [(100, " ".join([f"y{k}" for k in range(30)] + base[:170]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = similar.shingle_sets(docs, docs.select("doc_id"), 5)
    members = docs.selectExpr("7L AS key", "doc_id AS id", "0L AS rep", "101L AS size")
    named = spark.createDataFrame([(i, 0) for i in range(100)], "id long, component long")
    found = similar.left_edges(members, named, sets, 0.7, 8).collect()
    assert found and all({r["a"], r["b"]} - set(range(100)) == {100} for r in found)


def test_texts_that_repeat_passages(spark):
    """How often a passage is repeated makes no difference to a set."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for _ in range(20):
        own, passage = [word() for _ in range(300)], [word() for _ in range(50)]
        rows += [(len(rows) + k, " ".join(own + passage * n)) for k, n in enumerate((1, 5, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs).collect()} == similar_groups(rows)


def test_frequent_shingles(spark, monkeypatch):
    """Shingles that the bitmap names, and buckets and blobs far too small, change nothing."""
    rng = random.Random(15)
    for name, value in (("FREQUENT", 2), ("DEALT", 500), ("BUCKET", 700), ("BLOCK", 4)):
        monkeypatch.setattr(similar, name, value)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    shared, rows = [word() for _ in range(60)], []
    for _ in range(60):
        words = shared + [word() for _ in range(rng.randrange(2, 30))]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:-1], word()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs).collect()} == similar_groups(rows)


def test_buckets_make_no_rows(spark):
    """What comes back of a text's shingles is the same rows in one bucket and in many."""
    rng = random.Random(21)
    shared = [f"s{k}" for k in range(200)]
    rows = [(i, " ".join(shared[i : i + 60] + [f"o{i}x{k}" for k in range(rng.randrange(5, 40))])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    none = np.zeros(similar.SET_BITS // 8, np.uint8)
    one, many = ([tuple(r) for r in similar.shared_shingles(docs, docs.select("doc_id"), none, 5, 0.8, n).collect()] for n in (1, 16))
    assert len(one) == len(many) and sorted(one) == sorted(many)
    times = Counter(w for _, t in rows for w in {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    assert len(one) == sum(n for n in times.values() if n > 1)


def test_ids_with_several_texts(spark):
    """One text of an id counts, and all its rows go or stay."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, b), (4, "x")], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in similar.without_near_duplicates(docs).collect())
    assert kept in ([1, 3, 3, 4], [1, 2, 2, 4])


def test_hubs_are_dealt_out(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 300)] + [(1000, 299), (2000, 2001)], "a long, b long")
    want = {**dict.fromkeys([*range(1, 300), 1000], 0), 2001: 2000}
    assert {r["id"]: r["component"] for r in simhash.components(edges, hub=50).collect()} == want
