"""Corpus pipeline: documents -> language ID -> toxicity -> near-dedup -> mix -> packed sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows it is given, and returns a DataFrame with the columns of
``documents`` (the last one: packed pieces). ``run`` applies them to the
documents table, writing each result as Parquet under the shared checkpoint
folder and reading it back as the next stage's input.

Empty and null texts are rejected by the first stage (no letters). A document
that the mix takes twice is two rows afterwards, and is packed twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import language_id, mixing, near_text, packing, toxicity
from trailmark.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c) for c in COLUMNS])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in which no language is found go."""
    return language_id.keep_identified(_columns(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents with a score of 0.5 or more go."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return toxicity.keep_clean(_columns(docs), labels)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays; documents are near
    from 80% of common five-word shingles on."""
    return near_text.keep_one(_columns(docs), percent=80, width=5).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix of the sources: each row as often as it is taken, in mixing order."""
    return mixing.mixed_documents(_columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learnt models and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        out = materialize(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out
