"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes disguises one character at a time (case, accents, look-alike letters of other
scripts, digits and signs for letters), so that places stay comparable with the original, where word
borders are checked.  Words of exception phrases don't count.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, labelled_sample, map_batches, table, text_bytes

#: Labelled rows that weights are learned from, at most (about; taken by a hash of the id).
TRAIN_ROWS = 20_000
#: Words and word beginnings (written ``stem*``) learned from labels, at most.
LEARNED_WORDS = 500
STEMS = range(4, 8)

# --- fixed values: words that are insults on their own, and phrases in which such words are not
SEEDS = ("idiot", "moron", "imbecile", "stupid", "dumb", "scum", "trash", "garbage", "loser", "worthless", "pathetic", "disgusting", "vermin", "clown", "freak", "pig", "jerk", "bastard", "bitch", "asshole", "shit", "fuck", "hate you", "kill yourself", "shut up")
EXCEPTIONS = ("trash can", "trash bin", "garbage can", "garbage collection", "garbage collector", "clown fish", "class clown", "guinea pig", "pig iron", "control freak", "sore loser", "idiot proof", "pathetic fallacy")
# --- fixed values: signs and letters of other scripts that are written for Latin ones
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
LOOKALIKES = dict(zip("аеорсухіјѕһԁвмнктгαεοριυνκτχ", "aeopcyxijshdbmhktraeopiuvktx", strict=True))
SEED_WEIGHT = 2.0


def fold_table(disguises: bool) -> dict[int, str]:
    """Characters and what they stand for; always one for one."""
    found = {}
    for code in [*range(0x41, 0x5B), *range(0xC0, 0x590), *range(0x1E00, 0x2000), *range(0xFF21, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()[:1]
        base = LOOKALIKES.get(base, base)
        if base and base != chr(code):
            found[code] = base
    found |= {ord(k): v for k, v in LOOKALIKES.items()}
    return found | {ord(k): v for k, v in DISGUISES.items()} if disguises else found


def folded_words(text: str, letters: dict[int, str]) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in text.translate(letters)).split()


class Lexicon:
    """Weighted phrases and exceptions in one automaton."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.automaton, self.letters = ahocorasick.Automaton(), fold_table(True)
        phrases = {p: (len(p), w, False) for p, w in weights.items() if p[-1] != "*"} | {p: (len(p), 0.0, False) for p in EXCEPTIONS}
        for p, w in weights.items():
            if p[-1] == "*":
                phrases[p[:-1]] = (len(p) - 1, max(w, phrases.get(p[:-1], (0, 0.0))[1]), True)
        for phrase, entry in phrases.items():
            self.automaton.add_word(phrase, entry)
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """Places of matches of whole words or of their stems, one at a place; exceptions hide what they cover."""
        plain = text.translate(self.letters)
        found = []
        for end, (n, weight, stem) in self.automaton.iter(plain):
            start, after = end - n + 1, end + 1
            if (start == 0 or not text[start - 1].isalpha()) and (stem or after == len(text) or not text[after].isalpha()) and any(c.isalpha() for c in text[start:after]):
                found.append((start, after, weight))
        hidden = [(a, b) for a, b, w in found if w == 0]
        best = {}
        for a, b, w in found:
            if w > best.get(a, (0, 0.0))[1] and not any(x <= a and b <= y for x, y in hidden):
                best[a] = (b, w)
        return [(a, b, w) for a, (b, w) in best.items()]

    def features(self, text: str) -> list[float]:
        """Weight found, the same per hundred words, (both on a log scale), and the share h/(1+h) of h hits."""
        hits = self.hits(text)
        if not hits:
            return [0.0, 0.0, 0.0]
        total, words = sum(w for *_, w in hits), max(1, len(text.split()))
        return [float(np.log1p(total)), float(np.log1p(100 * total / words)), float(len(hits) / (1 + len(hits)))]


def learn_words(sample: DataFrame, toxic: int, clean: int, limit: int = LEARNED_WORDS) -> dict[str, float]:
    """Words and stems of toxic rows and their smoothed log odds; only clear and repeated ones.

    A stem makes the words and longer stems that begin with it superfluous, unless one of these is in
    nearly all of its rows: then it is the stem that goes.
    """

    def work(batches):
        yes, no, letters = Counter(), Counter(), fold_table(False)
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = {w for w in folded_words(text.decode("utf-8", "replace"), letters) if 3 <= len(w) <= 30}
                (yes if y else no).update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})
        if yes:
            # a word that no toxic row of this task has can still be common elsewhere: all are counted
            words = [*yes, *(w for w in no if w not in yes)]
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([yes[w] for w in part], pa.int64()), pa.array([no[w] for w in part], pa.int64())], names=["word", "yes", "no"])
        elif no:
            words = list(no)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([0] * len(words), pa.int64()), pa.array([no[w] for w in words], pa.int64())], names=["word", "yes", "no"])

    odds = F.log((F.col("yes") + 0.5) / (toxic + 1)) - F.log((F.col("no") + 0.5) / (clean + 1))
    least = max(5, toxic // 33)  # copies of one text repeat its words
    counts = map_batches(sample, work, "word string, yes long, no long").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    top = counts.where(F.col("yes") >= least).withColumn("odds", odds).where("odds > 2.5").orderBy(F.desc("odds"), "word").limit(limit).collect()
    seen = {r["word"]: r["yes"] for r in top}
    longer = lambda w: any(x != w and x.startswith(w[:-1]) and len(x.rstrip("*")) >= len(w) and n >= 0.95 * seen[w] for x, n in seen.items())
    found = {r["word"]: r["odds"] for r in top if not (r["word"][-1] == "*" and longer(r["word"]))}
    begun = lambda w: any(w[:n] + "*" in found for n in STEMS if n < len(w.rstrip("*")) or n == len(w) and w[-1] != "*")
    return {w: odds for w, odds in found.items() if not begun(w)}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    t = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(t)), x.T @ (p - y) + ridge * t)
        t -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return t


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon's weights, and how its features become a probability."""
    sample = cut(labelled_sample(docs, labels, "toxic", rows))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    weights = dict.fromkeys(SEEDS, SEED_WEIGHT)
    if not 0 < toxic < n:
        return weights, np.array([1.0, 1.0, 0.5, -4.0])
    weights |= learn_words(sample, toxic, n - toxic)

    def work(batches):
        lexicon = Lexicon(weights)
        for batch in batches:
            found = [lexicon.features(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    seen = map_batches(sample, work, "y int, x array<double>").groupBy("y", "x").count().toArrow()  # a bounded sample
    times = np.array(seen.column("count").to_pylist())
    x, y = np.repeat(np.array(seen.column("x").to_pylist(), np.float64).reshape(-1, 3), times, 0), np.repeat(np.array(seen.column("y").to_pylist(), np.float64), times)
    order = np.lexsort((*x.T, y))
    return weights, fit_logistic(x[order], y[order])


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted, matches`` for every row, from its whole text only.

    A null or empty text, like one without matches, gets the score of no matches.  Without labelled
    rows of both classes the lexicon is the fixed one, with fixed weights.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))  # at most SEEDS and LEARNED_WORDS phrases

    def work(batches):
        weights, t = model.value
        lexicon = Lexicon(weights)
        for batch in batches:
            x = np.array([lexicon.features(b.decode("utf-8", "replace")) for b in batch.column(2).to_pylist()], np.float64).reshape(-1, 3)
            scores = 1 / (1 + np.exp(-np.clip(x @ t[:3] + t[3], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(np.round(x[:, 2] / (1 - x[:, 2])).astype(np.int64))], names=["doc_id", "held_out", "score", "predicted", "matches"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id")) == 0).alias("held_out"), text_bytes(F.col("text"))), work, "doc_id long, held_out boolean, score double, predicted int, matches long")


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that ``toxicity_scores`` gives less than ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))  # at most SEEDS and LEARNED_WORDS phrases
    at = docs.columns.index("text")

    def work(batches):
        weights, t = model.value
        lexicon = Lexicon(weights)
        for batch in batches:
            x = np.array([lexicon.features(s or "") for s in batch.column(at).to_pylist()], np.float64).reshape(-1, 3)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ t[:3] + t[3], -30, 30))) < threshold))

    return map_batches(docs, work, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
