"""Language-model scores: a log-bilinear model over word classes, trained by noise-contrastive estimation.

Every token has a class: the most frequent words one each, any other word that of its ending.  The
model predicts the next token's class from the classes of the tokens before it, as a bilinear form of
their vectors; ``p(word) = p(class | context) * p(word | class)``, the latter from smoothed counts of
the whole training part.  Classes are few, so that log-probabilities are normalised exactly, by
batched matrix products.

Counts of all words are a distributed table.  Only its most frequent words (a fixed number) are
broadcast; tokens of other words are joined to the table, so neither side has a frequent key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_batches, stored, table, text_bytes

#: Words whose counts are broadcast (about 15 MB in a worker).
HEAD_WORDS = 100_000
#: Classes: words of their own (the end of a text among them), endings, and one for the rest.
WORD_CLASSES, ENDING_CLASSES = 128, 127
CLASSES = WORD_CLASSES + ENDING_CLASSES + 1
CONTEXT, SIZE = 4, 16
NOISE, BATCH, RATE = 24, 4096, 0.15
#: Samples of noise that a batch shares; each stands for a part of a token's NOISE.
DRAWN = 96
#: Tokens normalised, or set against noise, at a time: their scores stay in a core's cache.
TOGETHER = 512
#: Tokens of short texts that are gathered before their classes are scored.
GATHERED = 1 << 16
#: Documents that the driver's first fit looks at, before the fit on all of them.
WARM_ROWS = 2000
#: Words a task counts before it hands on what it has.
COUNTED_WORDS = 400_000
END = b""


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` over the training texts ``text``; the end of a text is the empty word."""

    def work(batches):
        from collections import Counter

        seen = Counter()

        def rows():
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens(text))
            if len(seen) > COUNTED_WORDS:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    return map_batches(docs, work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Places(dict):
    """Places of frequent words; of any other word -1 less its class, which is that of its ending."""

    def __init__(self, words: list[bytes], ending: dict[bytes, int]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.ending = ending

    def __missing__(self, word: bytes) -> int:
        return -1 - self.ending.get(word[-2:], CLASSES - 1)


class Classes:
    """Numbers of words' classes, and counts of the frequent ones."""

    def __init__(self, words: list[bytes], counts: list[int], endings: list[bytes]):
        self.counts = np.array(counts, np.float64)
        self.ending = {e: WORD_CLASSES + i for i, e in enumerate(endings)}
        self.at = Places(words, self.ending)
        own = min(len(words), WORD_CLASSES)
        self.of_head = np.array([*range(own), *(self.ending.get(w[-2:], CLASSES - 1) for w in words[own:])], np.uint8)

    def parts(self) -> tuple:
        return list(self.at), self.counts.tolist(), list(self.ending)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places among the frequent words (-1: none) and classes."""
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if not len(self.of_head):
            return np.full(len(at), -1), (-1 - at).astype(np.uint8)
        cls, other = self.of_head.take(at, mode="clip"), np.flatnonzero(at < 0)
        cls[other] = -1 - at[other]
        at[other] = -1
        return at, cls


def start_parameters() -> dict[str, np.ndarray]:
    random = np.random.default_rng(5)
    return {"r": random.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32), "q": random.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32), "c": np.ones((CONTEXT, SIZE), np.float32) * np.float32(0.5), "b": np.zeros(CLASSES, np.float32)}


def contexts(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' classes, and those of the CONTEXT tokens before each, nearest first; ends of texts before its start (class 0)."""
    cls = np.concatenate(sequences)
    starts = np.cumsum([0, *(len(s) for s in sequences[:-1])])
    out = np.zeros((CONTEXT, len(cls)), cls.dtype)
    for j in range(1, CONTEXT + 1):
        out[j - 1, j:] = cls[: max(0, len(cls) - j)]
        for k in range(j):  # past a short text's end these are tokens as near to the next one's start
            at = starts + k
            out[j - 1, at[at < len(cls)]] = 0
    return cls, out


def place_vectors(p: dict[str, np.ndarray]) -> np.ndarray:
    """Classes' vectors for each place of a context."""
    return p["r"] * p["c"][:, None, :]


def predicted(vectors: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Predicted vectors: sums of the context's vectors, each scaled by its place's weights."""
    out = vectors[0].take(ctx[0], axis=0)
    for j in range(1, CONTEXT):
        out += vectors[j].take(ctx[j], axis=0)
    return out


def added(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows by class."""
    order, sizes = np.argsort(ids, kind="stable"), np.bincount(ids, minlength=CLASSES)
    found = np.flatnonzero(sizes)
    out = np.zeros((CLASSES, rows.shape[1]), np.float32)
    out[found] = np.add.reduceat(rows.take(order, axis=0), (np.cumsum(sizes) - sizes)[found], axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with Adagrad; noise follows the classes' own frequencies."""

    def __init__(self, p: dict[str, np.ndarray], noise: np.ndarray, seed: int):
        self.p, self.noise, self.random = {k: v.copy() for k, v in p.items()}, noise, np.random.default_rng(seed)
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.cumulated = np.cumsum(noise)
        self.squares = {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}
        self.steps = 0

    def step(self, ctx: np.ndarray, target: np.ndarray) -> None:
        p, n = self.p, len(target)
        drawn = np.minimum(np.searchsorted(self.cumulated, self.random.random(DRAWN)), CLASSES - 1)
        vector = np.ones((n, SIZE + 1), np.float32)  # the last column is for the biases
        vector[:, :SIZE] = predicted(place_vectors(p), ctx)
        noise_q = p["q"][drawn]
        out = -np.concatenate([noise_q, (p["b"][drawn] - self.log_noise[drawn])[:, None]], 1).T.copy()
        own_q = p["q"].take(target, axis=0)
        own = np.einsum("td,td->t", vector[:, :SIZE], own_q) + (p["b"] - self.log_noise)[target]
        d_own = (1 / (1 + np.exp(-np.clip(own, -20, 20))) - 1).astype(np.float32)
        d_vector, d_drawn = d_own[:, None] * own_q, np.zeros((DRAWN, SIZE + 1), np.float32)
        for at in range(0, n, TOGETHER):
            here = vector[at : at + TOGETHER]
            others = here @ out
            np.clip(others, -20, 20, out=others)
            np.exp(others, out=others)
            others += 1
            np.divide(np.float32(NOISE / DRAWN), others, out=others)
            d_vector[at : at + TOGETHER] += others @ noise_q
            d_drawn += others.T @ here
        own_and_drawn = added(np.append(target, drawn.astype(target.dtype)), np.concatenate([d_own[:, None] * vector, d_drawn]))
        g = {"q": own_and_drawn[:, :SIZE], "b": own_and_drawn[:, SIZE]}
        sums = np.stack([added(c, d_vector) for c in ctx])
        g["r"], g["c"] = (sums * p["c"][:, None, :]).sum(0), (sums * p["r"]).sum(1)
        for k in p:
            grad = g[k] / np.float32(n) * np.float32(CLASSES / 8 if k != "c" else 1)
            self.squares[k] += grad * grad
            p[k] -= np.float32(RATE) * grad / np.sqrt(self.squares[k])
        self.steps += n

    def feed(self, sequences: list[np.ndarray]) -> None:
        if not sequences:
            return
        target, ctx = contexts(sequences)
        order = self.random.permutation(len(target))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            self.step(ctx.take(part, axis=1), target.take(part))


def log10_sequences(p: dict[str, np.ndarray], sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of texts' classes, each normalised over all classes."""
    cls, ctx = contexts(sequences)
    vectors, logs, ones = place_vectors(p), np.empty(len(cls), np.float32), np.ones(CLASSES, np.float32)
    out = np.concatenate([p["q"].T, p["b"][None], ones[None]])
    reach, lift = np.sqrt((p["q"] ** 2).sum(1).max()), p["b"].max()
    for at in range(0, len(cls), TOGETHER):
        target = cls[at : at + TOGETHER]
        full = np.ones((len(target), SIZE + 2), np.float32)  # the last columns are for the biases and the greatest score
        vector = full[:, :SIZE] = predicted(vectors, ctx[:, at : at + TOGETHER])
        # no score exceeds this; it is near enough for float32 unless vectors are very long
        top = np.sqrt(np.einsum("td,td->t", vector, vector)) * reach + lift
        far = top.max() > 60
        full[:, -1] = 0 if far else -top
        score = full @ out
        if far:
            score -= score.max(1)[:, None]
        own = score[np.arange(len(target)), target]
        np.exp(score, out=score)
        logs[at : at + TOGETHER] = own - np.log(score @ ones)
    text = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    return np.bincount(text, logs, len(sequences)) / np.log(10)


def log10_classes(p: dict[str, np.ndarray], cls: np.ndarray) -> float:
    """log10 probability of a text's classes."""
    return float(log10_sequences(p, [cls])[0])


def train(texts: DataFrame, classes: tuple, noise: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters from all texts ``doc_id, text``: a first fit on a bounded sample, then every input
    split goes on from there by itself and the splits' parameters are averaged by their tokens."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(classes)

    def classify(batches):
        own = Classes(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own.of(tokens(t))[1].tobytes() for t in batch.column(0).to_pylist()], pa.binary())], names=["cls"])

    n = texts.count()
    sample = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, WARM_ROWS / max(1, n)))).select("text")
    first = [np.frombuffer(x, np.uint8) for x in sorted(map_batches(sample, classify, "cls binary").toArrow().column(0).to_pylist())]
    p = start_parameters()
    p["b"] = np.log(noise).astype(np.float32)
    warm = Trainer(p, noise, 11)
    for _ in range(6):
        warm.feed(first)
    begun = spark.sparkContext.broadcast(warm.p)

    def fit(batches):
        own, trainer = Classes(*shared.value), Trainer(begun.value, noise, 13 + TaskContext.get().partitionId())
        for batch in batches:
            trainer.feed([own.of(tokens(t))[1] for t in batch.column(0).to_pylist()])
        if trainer.steps:
            flat = np.concatenate([trainer.p[k].ravel() for k in sorted(trainer.p)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * trainer.steps), pa.array(np.full(len(flat), float(trainer.steps)))], names=["i", "v", "w"])

    means = map_batches(texts.select("text"), fit, "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).toArrow().sort_by("i")  # as many rows as parameters
    if not means.num_rows:
        return warm.p
    flat, out, at = np.array(means.column("v").to_pylist(), np.float32), {}, 0
    for k in sorted(p):
        out[k] = flat[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    return out


def frequent_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most HEAD_WORDS words and counts, the end of a text first, then by count.

    They are those above a threshold, found on a coarse histogram of counts; no task sorts them all.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}  # at most 16 * 64 rows
    least, taken = max(sizes, default=0) + 1, 1
    for s in sorted(sizes, reverse=True):
        taken += sizes[s]
        if taken > HEAD_WORDS:
            break
        least = s
    found = counts.where((step >= least) | (F.col("word") == END)).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in found), key=lambda x: (x[0] != END, -x[1], x[0]))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Training texts are those whose crc32 of the id modulo 5 is not 1.  Null and empty texts are one
    token, the end.  Repeated rows are trained on and scored each time; rows without an id are training
    rows.  Without training texts every token has base probability 1 and the model is uniform over its
    classes.  Texts of any length count whole; an empty table gives no rows; other columns play no part.
    """
    held = fold(F.col("doc_id")) == 1
    texts = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), text_bytes(F.col("text")).alias("text"))
    training = texts.where(~F.col("held_out"))
    counts = stored(count_words(training.select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = frequent_words(counts)
    own = {w for w, _ in top[:WORD_CLASSES]}
    rest = counts.where(~F.col("word").isin([bytearray(w) for w in own])) if own else counts
    ending = F.substring("word", -2, 2)
    by_ending = rest.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    endings = [(bytes(r["e"]), r["c"], r["v"]) for r in by_ending.orderBy(F.desc("c"), "e").limit(ENDING_CLASSES).collect()]
    other = by_ending.where(~F.col("e").isin([bytearray(e) for e, *_ in endings])) if endings else by_ending
    other_c, other_v = other.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    classes = ([w for w, _ in top], [c for _, c in top], [e for e, *_ in endings])
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[: len(own)] = [c for _, c in top[: len(own)]]
    for i, (_, c, v) in enumerate(endings):
        class_n[WORD_CLASSES + i], class_v[WORD_CLASSES + i] = c, v
    class_n[-1], class_v[-1] = other_c, other_v
    noise = (class_n + 1) / (class_n + 1).sum()
    p = train(training.select("doc_id", "text"), classes, noise) if total else start_parameters()

    spark = docs.sparkSession
    base_all = float(np.log10(total + 0.5 * (distinct + 1)))
    log_sizes = np.log10(class_n + 0.5 * (class_v + 1))
    shared = spark.sparkContext.broadcast((classes, p, log_sizes))

    def score(batches):
        (head, head_counts, ends), p, sizes = shared.value
        known = Classes(head, head_counts, ends)
        logs = np.log10(known.counts + 0.5)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out, models, waiting, size = [], [], [], 0
            for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                at, cls = known.of(words)
                inside = at >= 0
                smoothed = inside & (cls >= WORD_CLASSES)  # words that share a class
                within = logs[at[smoothed]].sum() - sizes[cls[cls >= WORD_CLASSES]].sum()
                waiting.append(cls)
                size += len(cls)
                if size >= GATHERED:
                    models.extend(log10_sequences(p, waiting).tolist())
                    waiting, size = [], 0
                tail: dict[bytes, int] = {}
                for i in np.flatnonzero(~inside).tolist():
                    tail[words[i]] = tail.get(words[i], 0) + 1
                out.append((row, doc_id, held_out, len(words), int(inside.sum()), float(logs[at[inside]].sum() - base_all * len(words)), float(within), list(tail), list(tail.values())))
                row += 1
            if waiting:
                models.extend(log10_sequences(p, waiting).tolist())
            if out:
                types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                columns = [*zip(*out, strict=True)]
                columns[6] = [a + b for a, b in zip(columns[6], models, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "words", "times"])

    scored = stored(map_batches(texts, score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, words array<binary>, times array<long>"))
    tail = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("n"))
    joined = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    return scored.drop("words", "times").join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known", 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs", 0.0)).alias("base_score"), (F.col("model") + zero("logs", 0.0)).alias("score"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
