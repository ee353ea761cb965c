"""A training corpus from the documents table, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that go on, with the columns of
``documents``; the last returns where each of their pieces is packed.  Between stages the documents
are written as Parquet and read again.

Rows without an id are scored and packed like any other, keep their lines and are never near duplicates;
they go with the toxic ones, or if any row without an id holds a benchmark item.  Null and empty texts stay,
one of each group of texts without words in the near-duplicate stage.  Rows that repeat an id stay or go
together there and in decontamination.  Empty tables give no rows; other columns, whatever they are called,
go along up to the packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import decontaminate, lines, packing, similar, toxicity
from docquarry.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_duplicate_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]
#: Fingerprints and learned lexicons have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
