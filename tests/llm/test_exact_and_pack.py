import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docquarry.llm import exact, packing


def test_exact(documents, empty):
    rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in documents.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, least[t], len(groups[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = Counter(tuple(r) for r in exact.exact_duplicates(documents, salts=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want and exact.exact_duplicates(empty).count() == 0


def test_exact_with_equal_digests(spark, documents, monkeypatch):
    """Texts of one digest are told apart by their content."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "sha2", lambda column, bits: F.lit("ab" * 32))
    docs = documents.where("doc_id < 12")
    got = exact.exact_duplicates(docs)
    assert got.count() == docs.count() and got.select("keep_id").distinct().count() == docs.select("text").distinct().count()


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_pack_round_trip(documents, empty, whole):
    capacity = 64
    rows = packing.pack(documents, packing.default_tokenizer(), capacity).collect()
    docs = documents.select("doc_id", "text").collect()
    pieces = Counter()
    for i, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            pieces[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1] and sum(n for _, n in places) <= capacity
    assert len(by) <= -(-sum(r["length"] for r in rows) // capacity) + 2
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0


def test_odd_words(whole):
    encoder = packing.WordEncoder(packing.default_tokenizer())
    for text in ("Don't stop'S it's", "ÉA ﬁne ½ İstanbul x² 3.2% ab́c", "a b <|endoftext|> it<|startoftext|>a", "ΣΑΣ. 한국어. ... !!", "", "́a", "ABC.,;"):
        assert encoder.encode([text.encode()])[0] == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_fullest_like_every_subset():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 15): rng.randrange(1, 3) for _ in range(4)}
        room = rng.randrange(0, 30)
        items = [k for k, n in counts.items() for _ in range(n)]
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
        chosen = packing.fullest(counts, room)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


def test_plan_uses_up_the_histogram():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 2049): rng.randrange(1, 10**6) for _ in range(300)} | {2048: 10**9}
    used, bins = Counter(), 0
    for pattern, times in packing.plan_bins(histogram):
        assert sum(k * n for k, n in pattern.items()) <= 2048
        bins += times
        for k, n in pattern.items():
            used[k] += n * times
    assert used == histogram and bins < sum(k * n for k, n in histogram.items()) / 2048 * 1.01
