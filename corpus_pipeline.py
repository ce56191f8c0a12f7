"""A training corpus from documents: toxicity filter, near-duplicates, mixing, encoding.

Every stage is written as Parquet in the shared folder and read again as the next one's
input. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe_codec, minhash, mixing, toxicity
from lodestone.llm.common import drop_stage, mark, release, stage

VOCABULARY = "byte_bpe_50k.json"
#: Words of a shingle and the similarity from which documents are near-duplicates.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels come from the labels table, by doc_id.

    Null texts count as empty, rows with a null or repeated doc_id are judged by their texts.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id (null last).

    Rows are judged by their texts, whatever their ids; rows without words are in no
    group and stay.
    """
    return minhash.without_near_duplicates(docs, words=SHINGLE, percent=PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document and pass, with the words of the blocks that were drawn.

    Rows are told apart by a number of their own, so ids may be null or repeated.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to, per row of the mix.

    A null text is encoded as the empty one.
    """
    return bpe_codec.round_trip_digest(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix),
    ("bpe", encode),
]

#: A trained filter has no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; extra columns of documents go along up to it.

    Each stage's output is written, then what the stage wrote on its way and the output
    before it are deleted. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        since, before = mark(), docs
        docs = stage(function(spark, docs, sf_dir), name)
        release(since, keep=[docs])
        drop_stage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
