"""The corpus pipeline: language ID, near-dedup, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import decontaminate, langid, similar, suffix_dedup
from hearthline.llm.common import discard, ensure_checkpoint_dir, hold_few_rows, table
from hearthline.llm.packing import pack_documents

#: The stage is after passages of over 50 words: of all runs of 51 words, 99 in 100 have 247 bytes or more.
PASSAGE_BYTES = 240
#: Rows of whole texts, token ids or shingles that a Python worker gets at a time: some 2 MB of common texts.
BATCH_ROWS = 1000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with BATCH_ROWS a batch. What it returns runs later, so that the session keeps that limit."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hold_few_rows(spark, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language compression cannot tell; learned from those that have one."""
    return langid.keep_identified(docs, langid.dictionaries(docs))


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles are alike to 0.8 or more."""
    return similar.keep_one(docs)


@in_small_batches
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes that a repeated string of PASSAGE_BYTES covers."""
    return suffix_dedup.strip_documents(docs, PASSAGE_BYTES)


@in_small_batches
def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window of ten words."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontaminate_documents),
    ("packing", pack),
]

#: The stages hash, compress and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows go through the shared folder,
    and go once the next stage's are there."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            discard(spark, f"{folder}/{before}")  # what the stage has read
        before = name
    return docs
