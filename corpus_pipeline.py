"""From documents to token ids: language, exact copies, near copies, mix of sources, encoding.

Each stage takes what the one before it kept, with the columns of ``documents``, and is
written to the shared scratch folder before the next one reads it. The pipeline is a job of
its own, so its stages prepare the session they are given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnwheel.llm import bpe, exact_dedup, langid, mixing
from tarnwheel.llm import near_copies as near
from tarnwheel.llm.base import stored
from tarnwheel.session import prepare
from tarnwheel.sources.tables import load_table

# language models, fingerprints and merges are beyond SQL
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language known from the labelled ones; others and texts without letters go."""
    return langid.accepted(docs, langid.train(docs.where(~langid.held_out())))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard of 0.8 or more), the one with the smallest doc_id."""
    return near.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources near their target words."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of every document, decoded back from its ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # stored, so that a task runs one Python worker and not one for each step
    encoded = stored(bpe.encode(docs, path), "pipeline-ids")
    return bpe.decode(encoded, path).select("doc_id", "ids", *bpe.digests())


def _prepared(stage: Callable) -> Callable:
    return lambda spark, docs, sf_dir: stage(prepare(spark), docs, sf_dir)


STAGES = [
    ("language_id", _prepared(language)),
    ("exact_dedup", _prepared(exact_copies)),
    ("near_dedup", _prepared(near_copies)),
    ("source_mix", _prepared(mix)),
    ("byte_bpe", _prepared(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
