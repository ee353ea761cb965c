"""Licences, personal data and benchmark items."""

import hashlib
import random
import re
from collections import Counter

import pytest

from docquarry.llm import decontaminate, licenses, pii

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_licenses(spark, documents, empty):
    more = ["Released under the MIT License. Under the MIT license", "Licensed under the Apache License, Version 2.0.", "CC-BY-NC and cc by  nc", "This work is licensed under the GNU General Public License, version 3.", "the mit license under", "Dieses Werk mit der in of", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "İMIT K under the Kmit license"]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 1000)), "doc_id long, text string"))
    got = licenses.license_scan(docs).collect()
    assert len(got) == docs.count() and licenses.license_scan(empty).count() == 0
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    want = Counter()
    for (i, text), n in texts.items():
        words, places, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)), [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            parts = phrase.split()
            here = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            places += here
            found |= {label} if here else set()
        want[i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))] += n
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got if (r["doc_id"] or 0) >= 1000}
    assert [labels[i][0] for i in range(1000, 1004)] == ["mit", "apache-2", "cc-by-nc", "gpl-3"] and labels[1005] == ("", 0.0) and labels[1006][0] in ("", "mit")
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x[-9:]) <= 255 and (len(x.lstrip("0")) <= 3) for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_personal_data(spark, documents, empty):
    rng = random.Random(8)
    parts = ["a@b.c", "a@b.c_x@d.e", "x.y+z@mail-1.example.com,", "1.2.3.4.5.6.7.8", "999.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49.30.1234567", "+1", "é😀", "\n", "12", "@", ".", "+", "5 5", "token = \"abcdef0123456789abcdef\"", "(743) 555-3824", "Mr. John Smith", "99999999999999999999.1.1.1"]
    more = ["".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    docs = documents.where("doc_id < 1000").select("doc_id", "text").distinct().union(spark.createDataFrame(list(enumerate(more, 1000)), "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts) and pii.personal_data(empty).count() == 0
    for r in got:
        spans = base_spans(texts[r["doc_id"]])
        shown = [f"{k}:{a}:{b}" for a, _, b, k in spans]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == x for *_, k in spans) for x in BASE), texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r["spans"].split(",")) | {""}


def test_added_spans(spark):
    """Added spans are loose matches that no base span touches; with the marks that stand for borders in the text."""
    rng = random.Random(11)
    parts = ["a@b.c", "a [at] b [dot] org", "(743) 555-3824", "4111 1111 1111 1111", "4111111111111112", "token = \"abcdef0123456789abcdef\"", "Dr. Anna Weiss", "\ue000", "1.2.3.4", "call", "\n", "+1 (743) 555-3824", "743-555-3824", "password: a@b.cdefghijklmnopqrst"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for i in range(80)]
    rows += [(100, ""), (101, None), (102, "(743) 555-3824 " * 300 + "a@b.c " * 300)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    more = 0
    for i, text in rows:
        base, text = base_spans(text or ""), text or ""
        loose = []
        for kind, pattern in pii.LOOSE.items():
            pattern = re.sub(r"\(\?i:(\w+)\)", lambda m: "".join(f"[{c}{c.upper()}]" for c in m[1]), pattern)
            loose += [(m.start(), pii.KINDS.index(kind), m.end(), kind) for m in re.finditer(pattern, text)]
        free = {f"{k}:{a}:{b}" for a, _, b, k in loose if not any(a < y and x < b for x, _, y, _ in base)}
        shown = [s for s in got[i]["spans"].split(",") if s]
        own = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert [s for s in shown if s in own] == own and set(shown) - set(own) <= free and got[i]["n_spans"] == len(shown) == len(set(shown))
        more += len(shown) - len(own)
    assert more > 300


def test_texts_of_numbers(spark):
    """Time grows about in proportion, whatever matches."""
    import time

    def seconds(text):
        began = time.perf_counter()
        row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)).collect()[0]
        return time.perf_counter() - began, row["n_spans"]

    seconds("1 2")
    base, _ = seconds("12 a@b.c")
    for part, n in (("1,250.99 17 ", 0), ("4111111111111111; ", 1), ("a@b.org, ", 1), ("(743) 555-3824 ", 1)):
        times = 10**6 // len(part)
        took, found = seconds(part * times)
        assert found == n * times and took - base < 40, (part, took, base)


def test_reliabilities():
    """Votes that agree with sure ones count, and a labeler that says yes to everything doesn't."""
    counts = {(0, 1, 1, 1, 1): 50, (0, 1, 1, 1, 0): 80, (0, 0, 2, 0, 1): 60, (0, 0, 1, 1, 1): 20, (0, 0, 2, 2, 0): 90}
    post = pii.estimate(counts)
    assert post[0, 1, 1, 1, 0] > 0.9 and post[0, 0, 1, 1, 1] > 0.5 and post[0, 0, 2, 0, 1] < 0.5 and post[0, 0, 2, 2, 0] < 0.1


def contaminated(docs, items):
    """All windows of an item's size, whatever they share."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for d, text in docs:
        s = shingles(words(text))
        for b, item in items:
            t = shingles(words(item))
            if t and s and d is not None:
                best = 0.0
                for start in range(max(1, len(s) - len(t) + 1)):
                    x, y = Counter(s[start : start + len(t)]), Counter(t)
                    best = max(best, sum((x & y).values()) / sum((x | y).values()))
                if best >= 0.8:
                    out[d, b] = best
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_contamination(spark, documents, empty, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", most)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", most)
    rng = random.Random(6)
    item = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("stuvw") for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate((30, 30, 45, 60, 8, 5, 4, 40))] + [(20, None), (21, ""), (22, "of the of the of the of the of the"), (23, "of the of the of the of the of the")]
    docs = []
    for d in range(60):
        words = items[d % 8][1].split()
        for _ in range(d // 12):
            words[rng.randrange(len(words))] = "other"
        if d % 9 == 0:
            words.insert(len(words) // 2, "inserted")
        before, after = item(rng.randrange(0, 40)), item(rng.randrange(0, 40))
        docs.append((d, before + " " + ", ".join(words).upper() + ". " + after))
    docs += [(100, " ".join(items[0][1].split()[:20])), (101, items[1][1] + " " + items[1][1]), (102, "of the " * 40), (103, None), (104, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(frame, bench).collect()}
    want = contaminated(docs, items)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    kept = decontaminate.without_contaminated(frame, bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} and kept.columns == frame.columns
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(frame, bench.limit(0)).count() == 0


def test_contamination_out_of_order(spark):
    """An item whose halves are swapped shares its shingles at other places."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("stuvw") + rng.choice("abcdefgh") for _ in range(n))
    items, docs = [(n, text(n)) for n in (60, 80, 120)], []
    for n, item in items:
        words = item.split()
        docs.append((n, " ".join([text(30), *words[n // 2 :], *words[: n // 2], text(40)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = contaminated(docs, items)
    assert set(want) == {(n, n) for n, _ in items} and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_fingerprints_by_counting(spark):
    rng = random.Random(1)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 3, 40, 41, 700)] + [([-1] * 9,), ([7, 7, -8],)]
    got = [r["fp"] for r in spark.createDataFrame(rows, "h array<long>").coalesce(1).select(decontaminate.simhash(decontaminate.F.col("h")).alias("fp")).collect()]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) for (h,) in rows]
    assert [v % (1 << 64) for v in got] == want


def test_blocks_cover_the_radius():
    """Any two fingerprints within the radius differ in few bits of some block."""
    rng = random.Random(2)
    edges = [sum(decontaminate.BLOCKS[:k]) for k in range(len(decontaminate.BLOCKS) + 1)]
    assert edges[-1] == 64
    for _ in range(2000):
        bits = rng.sample(range(64), decontaminate.RADIUS)
        assert min(sum(a <= b < z for b in bits) for a, z in zip(edges, edges[1:], strict=False)) <= decontaminate.FLIPS
