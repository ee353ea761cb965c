"""Quality classifier: naive Bayes features in a support vector machine (NBSVM).

A text is a set of n-gram indicators: one- and two-grams of its words and of word *shapes* (``Aa``,
``AA!!``, ``a###``), which see junk that no vocabulary lists.  An indicator counts with its class
log-count ratio, and a linear hinge-loss model over these is fitted by dual coordinate descent.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_batches, stored, table, text_bytes

#: Labelled rows a model is fitted on, at most (about; taken by a hash of the id).
TRAIN_ROWS = 20_000
#: Features of those rows, at most (64 MB on the driver; rows are taken by a hash of the id as far as they fit).
TRAIN_FEATURES = 1 << 24
BITS = 20
CACHE_WORDS = 200_000
UPPER, LOWER, DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")
MIN_DOCS = 3


class Features:
    """Sorted distinct feature numbers of texts; words are analysed once."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = (1 << bits) - 1, {}

    def word(self, word: bytes) -> tuple[int, int]:
        shape = DIGIT.sub(b"9", LOWER.sub(b"a", UPPER.sub(b"A", word)))
        bare = word.lower().strip(b".,;:!?\"'()|")
        return zlib.crc32(b"w" + bare) & self.mask, zlib.crc32(b"s" + shape) & self.mask

    def of(self, text: bytes) -> np.ndarray:
        words, known = text.split(), self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.word(w)
        ones = np.array(list(map(known.__getitem__, words)), np.int64).reshape(-1, 2)
        return np.unique(np.concatenate([ones[:, 0], ones[:, 1], self.two(ones[:, 0], 1), self.two(ones[:, 1], 2)])).astype(np.int32)

    def two(self, numbers: np.ndarray, kind: int) -> np.ndarray:
        """Numbers of the two-grams, mixed so that their low bits depend on both parts."""
        mixed = ((numbers[:-1] << 22 | numbers[1:]) * 4 + kind) * np.int64(0x9E3779B97F4A7C15 - (1 << 64))
        return mixed >> np.int64(40) & self.mask


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log ratio of each indicator's share in class 1 and class 0; 0 for rare ones."""
    p, q = np.zeros(size), np.zeros(size)
    for x, c in zip(rows, y, strict=True):
        (p if c else q)[x] += 1
    ratio = np.log((p + 1) / (y.sum() + 2)) - np.log((q + 1) / ((1 - y).sum() + 2))
    return np.where(p + q >= MIN_DOCS, ratio, 0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: np.ndarray, epochs: int = 20, seed: int = 1) -> np.ndarray:
    """Weights of a linear model with hinge loss (the last is the bias, regularised like the others).

    Minimises ``w w / 2 + sum c max(0, 1 - y w x)``.  Every step solves one row's dual variable, between 0 and
    the row's cost ``c``, exactly.
    """
    w, alpha, sign = np.zeros(size + 1), np.zeros(len(rows)), np.where(y > 0, 1.0, -1.0)
    norms = np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (w[x] @ v + w[size]) - 1
            new = min(c[i], max(0.0, alpha[i] - gradient / norms[i]))
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                w[size] += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4:
            break
    return w


def fit_sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``a, b`` such that ``1 / (1 + exp(-(a * margin + b)))`` is a probability (ridge 1, Newton)."""
    x, t = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.1, x.T @ (p - y) + 0.1 * (t - [1, 0]))
        t = t - step
        if abs(step).max() < 1e-9:
            break
    return float(t[0]), float(t[1])


def unit(values: np.ndarray) -> np.ndarray:
    norm = np.sqrt(values @ values)
    return values / norm if norm else values


def probability(x: np.ndarray, weights: np.ndarray, ratio: np.ndarray, bias: float, a: float, b: float) -> float:
    """Of class 1, for a row of features."""
    margin = weights[x] @ unit(ratio[x]) + bias
    return float(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))


class Model:
    """Scores of feature rows; ``prior`` alone where no rows of both classes were given."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, bits: int = BITS):
        size = 1 << bits
        prior = (float(y.sum()) + 1) / (len(y) + 2)
        self.a, self.b, self.bias = 0.0, float(np.log(prior / (1 - prior))), 0.0
        self.weights, self.ratio = np.zeros(size, np.float32), np.zeros(size, np.float32)
        if 0 < y.sum() < len(y):
            ratio = log_count_ratios(rows, y, size)
            scaled = [unit(ratio[x]).astype(np.float32) for x in rows]
            part = np.arange(len(y)) % 5 == 0  # calibrates, then is trained on as well
            train = np.flatnonzero(~part)
            cost = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
            pick = lambda x, i: [x[j] for j in i]
            w = dual_coordinate_descent(pick(rows, train), pick(scaled, train), y[train], size, cost[train])
            held = np.flatnonzero(part)
            if 0 < y[held].sum() < len(held):
                self.a, self.b = fit_sigmoid(np.array([w[rows[i]] @ scaled[i] + w[size] for i in held]), y[held])
            else:
                self.a, self.b = 2.0, 0.0
            w = dual_coordinate_descent(rows, scaled, y, size, cost)
            self.bias, self.ratio = w[size], ratio.astype(np.float32)
            self.weights = w[:size].astype(np.float32)

    def parts(self) -> tuple:
        return self.weights, self.ratio, self.bias, self.a, self.b


def first_left_out(hashes: np.ndarray, sizes: np.ndarray, most: int) -> int | None:
    """The smallest hash at which rows, in the order of their hashes, are more than fit; None if all fit."""
    order = np.argsort(hashes, kind="stable")
    over = np.cumsum(sizes[order]) > most
    return int(hashes[order][over.argmax()]) if over.any() else None


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = TRAIN_FEATURES) -> Model:
    def work(batches):
        known = Features()
        for batch in batches:
            found = [known.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "x"])

    h = F.xxhash64("doc_id")
    sample = stored(map_batches(labelled_sample(docs, labels, "quality", rows), work, "doc_id long, y int, x array<int>"))
    sizes = sample.select(h.alias("h"), F.size("x").cast("long").alias("n")).toArrow()  # numbers of a bounded sample
    limit = first_left_out(sizes.column("h").to_numpy(), sizes.column("n").to_numpy(), features)
    if limit is not None:
        sample = sample.where(h < limit)
    # a bounded sample, as numbers; sorted, so that the fit doesn't depend on the order of tasks
    got = sample.withColumn("k", F.xxhash64("x")).toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("k", "ascending")])
    x = got.column("x").combine_chunks()
    ends = np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    return Model(np.split(x.flatten().to_numpy(), ends[:-1]) if len(ends) else [], got.column("y").to_numpy().astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from its whole text only.

    ``score`` is the probability of label 1; a null or empty text has no features and gets what the
    bias gives.  Without labelled rows of both classes it is the labels' share (0.5 without any).
    Texts of any length count whole, equal texts score the same, rows without an id are scored as held
    out, an empty table has no rows, and other columns, whatever they are called, play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows).parts())  # 8 MB, whatever the input

    def work(batches):
        features = Features()
        for batch in batches:
            scores = np.array([probability(features.of(t), *model.value) for t in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id")) == 0).alias("held_out"), text_bytes(F.col("text"))), work, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
