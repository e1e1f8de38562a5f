"""The corpus pipeline: documents through stages that each call one operator of ``tidemark.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet
in the shared folder and reread as the next stage's documents. All but the last return the columns
of documents.

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: of each group of near duplicates the smallest doc_id stays.
3. substrings: long word spans that a document with a smaller doc_id also has leave the texts.
4. mixing: documents repeat or go, so that sources come near their target weights.
5. packing: what is left as pieces of training sequences.

Defined results: null and empty texts pass stages 1 to 3 unchanged and have no words to take in 4;
rows with a null doc_id pass stages 1 to 3; rows repeated under one doc_id all stay, or go together;
ties go to the smallest doc_id; very long texts are treated whole; an empty table passes through; extra
columns, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bagminhash, debruijn, mixing, packing, toxicity
from tidemark.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.without_near_duplicates(docs.select(*COLUMNS))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_spans),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learning and tokenising have no SQL form; a test compares run() with brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs
