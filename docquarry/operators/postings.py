"""Inverted indexes: where each term is, per field and key (a document or a path)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_tokens
from ..schema import POSTINGS

#: Bytes of text whose postings one task puts in order: several 100 MB.  Their keys fit a Parquet dictionary.
PART_BYTES = 8 << 20
#: Tokens that are grouped at once.
CHUNK_TOKENS = 1 << 20


def build(texts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``term, field, key, tf, positions`` of every text column in ``fields``.

    A key's tokens are in one row, so grouping them needs no rows of other tasks before the shuffle.  For
    queries that name terms: only these are shuffled.
    """
    parts = F.array(*(F.struct(F.lit(f).alias("field"), index_tokens(F.col(f)).alias("tokens")) for f in fields))
    rows = texts.select(F.col(key).alias("key"), F.explode(parts).alias("p")).select("key", "p.field", F.posexplode("p.tokens").alias("pos", "term"))
    grouped = rows.groupBy("term", "field", "key").agg(F.sort_array(F.collect_list("pos")).alias("positions"))  # one text's own places
    return grouped.select("term", "field", "key", F.size("positions").alias("tf"), "positions")


def _grouped(keys: pa.Array, tokens: pa.ListArray, field: str) -> pa.RecordBatch:
    """The postings of one field of some texts: tokens by text and term, places in order."""
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    terms, n = max(len(coded.dictionary), 1), int(sizes.sum())
    own = np.repeat(np.arange(len(sizes)), sizes) * terms + coded.indices.to_numpy(zero_copy_only=False)
    places = (np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    order = np.argsort(own, kind="stable")
    own = own[order]
    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[begins, n].astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(places[order]))
    columns = [coded.dictionary.take(pa.array(own[begins] % terms)), pa.array([field] * len(begins), pa.string()), keys.take(pa.array(own[begins] // terms)), pa.array(np.diff(ends)), positions]
    return pa.RecordBatch.from_arrays(columns, names=POSTINGS.names)


def whole(texts: DataFrame, key: str, fields: list[str], size: int) -> DataFrame:
    """``build`` for texts of ``size`` bytes with a key of their own each, all of it, as stored: sorted by term in parts
    of some texts.

    Texts are shuffled, not their postings, which are many times as large: a part has all postings of its keys, and
    equality and prefix filters skip row groups and pages of each part.
    """
    dealt = texts.where(F.col(key).isNotNull()).repartition(max(1, -(-size // PART_BYTES)), key)
    rows = dealt.select(F.col(key).cast("string").alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), index_tokens(F.col(f)).alias("tokens")) for f in fields))).alias("p")).select("key", "p.field", "p.tokens").where("size(tokens) > 0")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in fields:
                of = batch.filter(pc.equal(batch.column(1), field))
                upto = np.cumsum(of.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                at = 0
                while at < len(upto):  # at least one text
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK_TOKENS, "right")))
                    yield _grouped(of.column(0).slice(at, end - at), of.column(2).slice(at, end - at), field)
                    at = end

    return rows.mapInArrow(work, POSTINGS).sortWithinPartitions("term", "key")


def named(texts: DataFrame, key: str, fields: list[str], terms: Callable[[Column], Column], *more: str) -> DataFrame:
    """``key, n_tokens, found`` and ``more`` of the columns: postings of those terms only, which a query names, in each text's own row.

    One reading of the texts gives both what a query scans and the lengths that ranking needs.
    """
    parts = F.array(*(F.struct(F.lit(f).alias("field"), index_tokens(F.col(f)).alias("tokens")) for f in fields))
    rows = texts.select(F.col(key).alias("key"), *more, parts.alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + F.size(p.tokens))
    hit = lambda p: F.filter(F.transform(p.tokens, lambda t, i: F.when(terms(t), F.struct(t.alias("term"), i.alias("pos")))), lambda x: x.isNotNull())
    hits = F.transform("p", lambda p: F.struct(p.field.alias("field"), hit(p).alias("hits")))
    rows = rows.select("key", *more, total.alias("n_tokens"), hits.alias("p"))
    places = lambda p, t: F.transform(F.filter(p.hits, lambda x: x.term == t), lambda x: x.pos)
    of = lambda p: F.transform(F.array_distinct(F.transform(p.hits, lambda x: x.term)), lambda t: F.struct(t.alias("term"), p.field.alias("field"), places(p, t).alias("positions")))
    return rows.select("key", *more, "n_tokens", F.flatten(F.transform("p", of)).alias("found"))


def of_named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings and the ``key_stats`` in the rows of ``named``."""
    found = rows.select("key", F.explode("found").alias("p")).select("p.term", "p.field", "key", F.size("p.positions").alias("tf"), "p.positions")
    return found, rows.select("key", "n_tokens")


def sums(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """``key_stats`` from the postings of all fields, for ``keys`` (one column), which may have none."""
    counted = postings.groupBy("key").agg(F.sum("tf").alias("n_tokens"))
    return keys.toDF("key").join(counted, "key", "left").select("key", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def key_stats(texts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, n_tokens`` over all fields; keys without tokens too."""
    total = reduce(lambda a, b: a + b, (F.size(index_tokens(F.col(f))) for f in fields))
    return texts.select(F.col(key).alias("key"), total.cast("long").alias("n_tokens"))


def laid_out(postings: DataFrame) -> DataFrame:
    """As stored: ranges of terms in order, so that equality and prefix filters both skip files."""
    return postings.repartitionByRange("term", "key").sortWithinPartitions("term", "key")
