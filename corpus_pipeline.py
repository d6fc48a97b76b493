"""A training corpus from raw documents: drop toxic texts, exact copies and near copies, mix sources, pack token ids.

Each stage works on all that the one before it kept, and its result is written as Parquet and read again before
the next. All but the last return the columns of `documents`, whatever their names; columns that they don't use pass through. Null and
empty texts, repeated rows, null ids and sources, and ties have the result that each stage states; an empty table gives an
empty result of each stage. ORACLE_SQL is None: a trained classifier, sampled signatures
and hash-seeded draws have no SQL; tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowmill.llm import bagminhash, exact_dedup, mixing, packing, toxicity
from flowmill.llm.common import materialize, prepare

VOCABULARY = "byte_bpe_50k.json"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose toxicity score reaches the threshold go. Null and empty texts score as no terms, equal texts alike; without labels the
    score is the same for all. Labels of ids that aren't there teach nothing."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays, of repeated rows with it one; null ids rank below all others. Null equals empty."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least id, of repeated rows one, null ids last. Texts without a
    word, null ones too, are copies of each other."""
    return bagminhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says. A null source is one of its own, ranked last; null texts have no words and
    follow their source's rate; repeated rows of an id are drawn alike."""
    prepare(spark)
    return mixing.emit(mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's token ids lie in the training sequences. Null and empty texts are the end id alone; each row is packed, repeated
    ones too, and copies of a document lie where they fit."""
    return packing.pack_pieces(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; an empty table gives no pieces."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
