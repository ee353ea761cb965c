"""Models: held-out quality, normalisation, and odd inputs."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docquarry.llm import lm, quality, toxicity
from docquarry.llm.common import table

SF = "/root/testdata/sf0.1"


def held_out_accuracy(scores, truth):
    rows = [(r["predicted"], truth[r["doc_id"]]) for r in scores.collect() if r["held_out"] and r["doc_id"] in truth]
    return sum(p == y for p, y in rows) / len(rows)


@pytest.mark.parametrize(("score", "label", "least"), [(toxicity.toxicity_scores, "toxic", 0.97), (quality.quality_scores, "quality", 0.97)])
def test_held_out(spark, score, label, least):
    labels = table(spark, SF, "labels")
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    docs = table(spark, SF, "documents").join(labels.select("doc_id"), "doc_id")
    assert held_out_accuracy(score(docs, labels), truth) >= least


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_odd_rows(documents, empty, labels, score):
    rows = score(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert score(empty, labels).count() == 0 and score(documents, labels.limit(0)).count() == len(rows)
    assert score(documents, labels.where("toxic = 0 AND quality = 1")).count() == len(rows)


def test_labels_of_held_out_rows_are_not_used(spark, documents, labels):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((str(r["doc_id"]), r["score"]) for r in quality.quality_scores(documents, x).collect()) for x in (labels, flipped))
    assert one == two


def test_lexicon():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "lowe*": 3.0, "trash": 1.0})
    hits = lambda t: [(t[a:b], w) for a, b, w in lexicon.hits(t)]
    assert hits("You IDIOT, 1d10t! іdіоt idiöt$$$ idiots xidiot") == [("IDIOT", 2.0), ("1d10t", 2.0), ("іdіоt", 2.0), ("idiöt", 2.0)]
    assert hits("loweich Loweient flower") == [("lowe", 3.0), ("Lowe", 3.0)] and hits("a trash can and trash") == [("trash", 1.0)] and hits("") == []
    assert hits("173 111 $$$ 0") == []


def plain_hits(weights, text):
    """Every lexicon entry tried at every place, in place of the automaton."""
    plain = text.translate(toxicity.fold_table(True))
    letter = lambda i: 0 <= i < len(text) and text[i].isalpha()

    def at(i, phrase, stem):
        end = i + len(phrase)
        return plain.startswith(phrase, i) and not letter(i - 1) and (stem or not letter(end)) and any(c.isalpha() for c in text[i:end])

    hidden = [(i, i + len(p)) for i in range(len(text)) for p in toxicity.EXCEPTIONS if at(i, p, False)]
    found = []
    for i in range(len(text)):
        here = [(w, len(p.rstrip("*"))) for p, w in weights.items() if at(i, p.rstrip("*"), p[-1] == "*")]
        here = [(w, n) for w, n in here if not any(a <= i and i + n <= b for a, b in hidden)]
        if here:
            found.append(max(w for w, _ in here))
    return found


def test_toxicity_scores_as_plain_python(spark):
    """The whole operator's scores, from the weights it learned and every place looked at."""
    said = ["you idiot", "what a m0ron", "class clown, clown", "Trash can and trash", "nice day", "a guinea pig or a pig", "IDIÖT idiots", "", "worthless scum", "blorpish fellow blorped"]
    rows = [(i, (said[i % len(said)] + " words that are there " * (i % 3)).strip() if i % len(said) != 7 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % len(said) in (0, 1, 2, 8, 9))) for i, _ in rows], "doc_id long, toxic int")
    weights, t = toxicity.train(docs, labels)
    assert any(w.startswith("blor") for w in weights)
    got = {r["doc_id"]: (r["score"], r["matches"], r["predicted"]) for r in toxicity.toxicity_scores(docs, labels).collect()}
    for i, text in rows:
        found = plain_hits(weights, text or "")
        total, n = sum(found), len(found)
        x = [math.log1p(total), math.log1p(100 * total / max(1, len((text or "").split()))), n / (1 + n)] if n else [0, 0, 0]
        p = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, t, strict=False)) + t[3])))
        assert got[i] == (pytest.approx(p, abs=1e-9), n, int(p >= 0.5))


def plain_features(text, bits=quality.BITS):
    """One- and two-grams of words and shapes, in plain Python."""
    mask, words = (1 << bits) - 1, text.encode().split()
    word = [zlib.crc32(b"w" + w.lower().strip(b".,;:!?\"'()|")) & mask for w in words]
    shape = [zlib.crc32(b"s" + re.sub(rb"[0-9]+", b"9", re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[A-Z]+", b"A", w)))) & mask for w in words]
    two = lambda kind, pair: ((((pair[0] << 22 | pair[1]) * 4 + kind) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40) & mask
    return sorted({*word, *shape, *(two(1, p) for p in zip(word, word[1:], strict=False)), *(two(2, p) for p in zip(shape, shape[1:], strict=False))})


def test_quality_scores_as_plain_python(spark, documents, labels):
    """The whole operator's scores: features, ratios, margins and probabilities by dictionaries."""
    texts = [(r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect()]
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = sorted((i, truth[i], plain_features(t)) for i, t in texts if i in truth)
    n = Counter(y for _, y, _ in rows)
    seen = {c: Counter(f for _, y, x in rows if y == c for f in x) for c in (0, 1)}
    ratio = lambda f: math.log((seen[1][f] + 1) / (n[1] + 2)) - math.log((seen[0][f] + 1) / (n[0] + 2)) if seen[0][f] + seen[1][f] >= quality.MIN_DOCS else 0.0
    model = quality.train(documents, labels)
    for f in {f for *_, x in rows for f in x}:
        assert model.ratio[f] == pytest.approx(ratio(f), abs=1e-6)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(documents, labels).collect()}
    for i, t in texts:
        v = {f: ratio(f) for f in plain_features(t)}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        margin = sum(float(model.weights[f]) * x / length for f, x in v.items()) + model.bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.a * margin + model.b))), abs=1e-5)


def test_features_of_a_fit_are_bounded(spark, documents, labels):
    h, n = np.array([5, -3, 9, 5]), np.array([10, 20, 30, 40])
    assert quality.first_left_out(h, n, 100) is None and quality.first_left_out(h, n, 75) == 9
    assert quality.first_left_out(h, n, 40) == 5 and quality.first_left_out(h, n, 0) == -3
    few = quality.train(documents, labels, features=300)
    assert 0 < np.count_nonzero(few.ratio) < np.count_nonzero(quality.train(documents, labels).ratio)
    assert not quality.train(documents, labels, features=0).weights.any()


def test_dual_coordinate_descent_reaches_the_least_hinge_loss():
    """No duality gap: the weights' objective is that of the dual variables behind them."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 6)) + (20 if i % 2 else 0) for i in range(200)]
    values, sign = [np.ones(len(x)) / 2 for x in rows], np.where(np.arange(200) % 2, 1.0, -1.0)
    cost = np.where(sign > 0, 0.3, 0.1)
    w = quality.dual_coordinate_descent(rows, values, (sign > 0).astype(float), 100, cost, epochs=2000)
    loss = lambda w: (w @ w) / 2 + cost @ np.maximum(0, 1 - sign * [w[x] @ v + w[100] for x, v in zip(rows, values, strict=True)])
    least = loss(w)
    assert least < 0.9 * loss(np.zeros(101))
    for _ in range(300):  # convex: nothing near is lower
        assert loss(w + rng.normal(0, 10.0 ** -rng.integers(1, 5), 101)) >= least - 1e-6
    x = np.zeros((200, 101))
    for i, (at, v) in enumerate(zip(rows, values, strict=True)):
        x[i, at], x[i, 100] = v, 1
    step = w.copy()
    for k in range(4000):  # plain subgradient descent gets no lower
        step -= (step - (cost * sign * (sign * (x @ step) < 1)) @ x) / (k + 2)
    assert least <= loss(step) + 1e-6 and loss(step) < 1.05 * least


def test_language_model(spark, documents, empty):
    rows = lm.language_model_scores(documents).collect()
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    texts = [(r["doc_id"], words(r["text"])) for r in documents.select("doc_id", "text").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in texts if not held(i) for w in t)
    total, size = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1))) for w in t)) for i, t in texts)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] < 0 for r in rows) and lm.language_model_scores(empty).count() == 0
    only_held = documents.where("doc_id = 3 OR doc_id = 9").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 1")
    assert lm.language_model_scores(only_held).count() == only_held.count()


def test_words_of_a_class_sum_to_one():
    """Classes are normalised for any context, and so is what is counted within one."""
    p = lm.start_parameters()
    p["q"] *= 20
    p["r"] *= 20
    context = np.array([7, 100, 3], np.uint8)
    each = [10 ** (lm.log10_classes(p, np.append(context, np.uint8(k))) - lm.log10_classes(p, context)) for k in range(lm.CLASSES)]
    assert sum(each) == pytest.approx(1, abs=1e-3)


def former_step(t, ctx, target):
    """A step of training with every sum written out: no blocks, no biases among the vectors."""
    p, n = t.p, len(target)
    drawn = np.minimum(np.searchsorted(t.cumulated, t.random.random(lm.DRAWN)), lm.CLASSES - 1)
    vector = sum(p["r"][c] * w for c, w in zip(ctx, p["c"], strict=True))
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -20, 20)))
    d_own = logistic((vector * p["q"][target]).sum(1) + p["b"][target] - t.log_noise[target]) - 1
    d_drawn = logistic(vector @ p["q"][drawn].T + p["b"][drawn] - t.log_noise[drawn]) * lm.NOISE / lm.DRAWN
    d_vector = d_own[:, None] * p["q"][target] + d_drawn @ p["q"][drawn]
    g = {k: np.zeros(v.shape) for k, v in p.items()}
    np.add.at(g["q"], target, d_own[:, None] * vector)
    np.add.at(g["q"], drawn, d_drawn.T @ vector)
    np.add.at(g["b"], target, d_own)
    np.add.at(g["b"], drawn, d_drawn.sum(0))
    for j, c in enumerate(ctx):
        np.add.at(g["r"], c, d_vector * p["c"][j])
        g["c"][j] = (d_vector * p["r"][c]).sum(0)
    for k in p:
        grad = g[k] / n * (lm.CLASSES / 8 if k != "c" else 1)
        t.squares[k] = t.squares[k] + grad * grad
        p[k] = p[k] - lm.RATE * grad / np.sqrt(t.squares[k])


def test_steps_and_scores_as_written_out():
    """Blocks and many texts at a time give what one text at a time and plain sums do."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, lm.CLASSES, n).astype(np.uint8) for n in (1, 2, 3, 1, 700, 4, 5, 1, 1300, 2)]
    before = lambda x: [[x[i - j] if i >= j else 0 for i in range(len(x))] for j in range(1, lm.CONTEXT + 1)]
    target, ctx = lm.contexts(texts)
    assert target.tolist() == np.concatenate(texts).tolist() and ctx.tolist() == np.concatenate([before(x) for x in texts], 1).tolist()
    noise = rng.random(lm.CLASSES) + 0.1
    one, two = (lm.Trainer(lm.start_parameters(), noise / noise.sum(), 4) for _ in range(2))
    for _ in range(5):
        one.step(ctx, target)
        former_step(two, ctx, target)
    assert all(one.p[k] == pytest.approx(two.p[k], abs=1e-4) for k in one.p)
    for scale in (1, 30):  # vectors so long that the bound of scores isn't near enough, too
        p = {**two.p, "q": two.p["q"] * scale}
        got = lm.log10_sequences({k: v.astype(np.float32) for k, v in p.items()}, texts)
        for x, value in zip(texts, got, strict=True):
            score = sum(p["r"][c] * w for c, w in zip(np.array(before(x)), p["c"], strict=True)) @ p["q"].T + p["b"]
            top = score.max(1)
            want = (score[np.arange(len(x)), x] - top - np.log(np.exp(score - top[:, None]).sum(1))).sum() / math.log(10)
            assert value == pytest.approx(want, rel=1e-4)


def test_classes_of_words():
    known = lm.Classes([b"", *(b"w%d" % i for i in range(lm.WORD_CLASSES))], [1] * (lm.WORD_CLASSES + 1), [b"27", b"ed"])
    at, cls = known.of([b"", b"w127", b"baked", b"w0", b"other", b"ed"])
    assert at.tolist() == [0, lm.WORD_CLASSES, -1, 1, -1, -1]
    assert cls.tolist() == [0, lm.WORD_CLASSES, lm.WORD_CLASSES + 1, 1, lm.CLASSES - 1, lm.WORD_CLASSES + 1]
    assert b"baked" not in known.at and lm.Classes([], [], []).of([b"x"])[1].tolist() == [lm.CLASSES - 1]


def test_texts_are_scored_together(spark, documents, monkeypatch):
    """However many texts wait for their scores, each gets its own."""
    key = lambda rows: sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 2)) for r in rows)
    together = key(lm.language_model_scores(documents).collect())
    monkeypatch.setattr(lm, "GATHERED", 1)
    alone = key(lm.language_model_scores(documents).collect())
    assert [x[:2] for x in together] == [x[:2] for x in alone]
    assert [x[2] for x in together] == pytest.approx([x[2] for x in alone], rel=1e-5, abs=0.02)


def test_better_than_counts(spark):
    rows = [r for r in lm.op2_lm_score(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)
