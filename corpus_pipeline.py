"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wearpath.llm import langid, linededup, packing, quality, simhash
from wearpath.llm.common import dropped, stage, stored, table


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; texts without letters or a clear language go."""
    labelled = table(spark, sf_dir, "documents")
    return langid.recognised(docs, langid.train(labelled.where(~langid.held_out())))


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines."""
    return quality.kept_documents(docs)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each repeated line in one of them only."""
    return linededup.without_repeated_lines(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints of four-word shingles link at 4 or fewer bits."""
    return simhash.dedup(docs, radius=4, width=4)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    paths = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack_documents(docs, packing.Encoder.read(*paths, public_tokenizers.PATTERN))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", pack),
]

#: Fitted networks and MinHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored in the shared folder until the one after it is."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        before, docs = docs, stored(work(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
