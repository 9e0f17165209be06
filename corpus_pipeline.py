"""The corpus pipeline: quality rules, near-duplicate removal, removal of repeated strings, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it left; all
but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontam, jaccard_join, pieces, quality, suffix_dedup
from tidewatch.llm.common import Work, table
from tidewatch.session import ship

PIECES = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the fertility bands keep."""
    ship(spark)
    return quality.score(docs, public_tokenizers.path(PIECES), keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id; rows without an id can't be told apart and stay."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts (and n_chars) without the strings and the passages of over 50 words that repeat."""
    ship(spark)
    return suffix_dedup.cut_repeats(docs, words=suffix_dedup.WINDOW)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    return decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each row."""
    ship(spark)
    return pieces.digest(docs, public_tokenizers.path(PIECES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("leaks", leaks), ("encoded", encoded),
]

#: SQL can't express the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again."""
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
