"""Best-fit packing of token sequences by minimum bin slack.

Spark tokenises every document and cuts it into pieces; only the histogram of piece lengths (at
most ``capacity`` numbers, whatever the corpus) comes to the driver, which plans the bins as
*patterns*: a multiset of lengths and how often it is used.  Each piece then finds its bin from its
rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, table, text_bytes

CAPACITY = 2048
#: Words whose ids a worker remembers (about 120 MB); beyond it forgets all and starts again.
CACHE_WORDS = 500_000
#: Words encoded as one text.
TOGETHER = 1000


class WordEncoder:
    """Ids of whole texts as little-endian bytes, by encoding white-space-separated words once.

    The tokenizer's own splitting never joins characters across white space, nor letters with the
    signs after them, so a text's ids are its words' ids in sequence.  Words of letters only are
    encoded many at a time and parted at the tokens that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_word[ends] = True

    def _each(self, words: list[bytes]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False), strict=True):
            self.known[word] = np.array(found.ids, "<u4").tobytes()

    def _letters(self, words: list[bytes]) -> None:
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):  # not a tokenizer that marks the ends of words
                self._each(part)
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(part, (ends * 4).tolist(), strict=True):
                self.known[word], at = data[at:end], end

    def learn(self, words: list[bytes]) -> None:
        letters, other, joined = set(), set(), []
        for w in words:
            bare = w.rstrip(b".,;:!?")
            if bare and (bare.isalpha() or (s := bare.decode("utf-8", "replace")).isalpha() and s.lower().isalpha() and "\ufffd" not in s):
                if bare not in self.known:
                    letters.add(bare)
                if bare != w:
                    joined.append((w, bare, w[len(bare) :]))
                    if w[len(bare) :] not in self.known:
                        other.add(w[len(bare) :])
            else:
                other.add(w)
        self._letters(list(letters))
        self._each(list(other))
        for w, bare, signs in joined:
            self.known[w] = self.known[bare] + self.known[signs]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.lower().split() for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        self.learn([w for w in set().union(*split) if w not in known])
        return [b"".join([known[w] for w in words]) for words in split]


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which keeps what it knows for its next tasks."""
    import os

    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = tokenizers.__dict__.setdefault("_docquarry_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and the piece's rank within its task and length.

    A document is its ids and then ``end_id``; only one longer than ``capacity`` is cut.  An empty
    or null text is the one id ``end_id``.
    """
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        encoder, task, ranks = worker_encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc_id, k, at // 4, n, zlib.crc32(part), task, ranks[n]))
                    ranks[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_bytes(F.col("text"))), work, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    A subset-sum dynamic program whose states are the bits of one integer; equal lengths enter in
    powers of two.  Longer lengths come first, and it stops once ``room`` itself is reachable.
    """
    mask, bits, steps = (2 << room) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not bits >> room & 1:
            take = min(part, left)
            steps.append((length, take, bits))
            bits |= bits << length * take & mask
            left, part = left - take, part * 2
        if bits >> room & 1:
            break
    at, chosen = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ``(length -> times in a bin, number of bins)`` that use up the histogram.

    Minimum bin slack: a bin takes the longest piece left and, of all that is left, the combination
    that fills it best, which is then removed.  As many bins are filled alike as the counts allow,
    so the work depends on how many lengths there are and not on how many pieces.
    """
    left, plan = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        pattern = fullest({k: v for k, v in rest.items() if v}, capacity - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[k] // m for k, m in pattern.items())
        plan.append((pattern, times))
        for k, m in pattern.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; an empty table gives no rows.

    Repeated rows and null ids are packed like any other.  Ties between pieces of one length are
    broken by input split and order.
    """
    placed = cut(pieces(docs, tokenizer, capacity))
    sums = placed.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = sums.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranges, used, first = defaultdict(list), defaultdict(int), 0
    for pattern, times in plan_bins(histogram, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            ranges[length].append((used[length], first, pattern[length], offset))
            used[length] += pattern[length] * times
            offset += length * pattern[length]
        first += times
    lookup = docs.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64).T for k, v in ranges.items()})

    def work(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                here = length == x
                low, base, times, start = lookup.value[int(x)]
                at = np.searchsorted(low, rank[here], side="right") - 1
                step = rank[here] - low[at]
                sequence[here] = base[at] + step // times[at]
                offset[here] = start[at] + step % times[at] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = placed.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return map_batches(ranked, work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
