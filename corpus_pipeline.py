"""Corpus pipeline: from raw documents to the token ids of a training mix.

Each stage works on all rows that the one before kept; its result is written as
Parquet to the shared folder and read again.  All but the last return the
columns of their input, whatever else these are.  An operator deletes the scratch
tables that it has written itself, and nothing else.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import bpe, jaccard, langid, mixing, suffix
from engram.llm.common import table, text_batches
from engram.session import shared_path

#: A text whose likeliest language has less than this is in no known language.  Texts of a word or two score
#: about 0.4 even when right, so the bar is little above chance.
LEAST_SCORE = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    """The documents with ``n_chars`` (if there is such a column) as their texts have it now."""
    now = F.length("text").cast("long")
    return docs.select(*[now.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language: not those without text or letters,
    and not those whose best language is below LEAST_SCORE."""
    return langid.in_known_language(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 0.8)."""
    return jaccard.one_per_component(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out what repeats for 400 bytes or more, in the same document or
    others; documents left without text go."""
    return _counted(suffix.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often, and as far, as their source's share takes them."""
    return _counted(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mix_sources", mix_sources), ("encode", encode)]
#: Training a network, connected components and merges are not SQL; tests/llm holds each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.  The results of the stages stay in the
    shared checkpoint folder."""
    folder = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        kept = stage(spark, docs, sf_dir)
        with text_batches(spark):
            kept.write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
