"""The corpus pipeline: five operators in a row, each working on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every
stage's result as Parquet below ``spark.checkpoint.dir`` and reads it again for the next one. All stages but the
last return the columns of ``documents``.

1. language: documents whose language cannot be told go; ``lang`` becomes the language found.
2. lines: lines that an earlier document holds are taken out of ``text``.
3. near copies: one document of each group stays (five-word shingles, similarity of 0.8 or more).
4. mixture: documents are replicated so that every source gives an equal share of the text.
5. packing: windows of 2048 tokens; rows are pieces with their token ids.

Every stage defines the cases of missing values, empty tables, repeated rows and clashing columns in its operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.line_dedup import line_dedup
from millrace.llm.minhash import Likeness, near_dedup
from millrace.llm.mixing import mix_sources
from millrace.llm.packing import pack
from millrace.llm.ppm import language_filter
from millrace.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_filter(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, Likeness(words=5, num=80))


def even_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("lines", fresh_lines),
    ("near_copies", no_near_copies),
    ("mixture", even_sources),
    ("packing", packed_windows),
]

#: Language scores, signatures and BM25 ranks cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
