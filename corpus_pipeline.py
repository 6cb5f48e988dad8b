"""A corpus in five stages: quality rules, line dedup, near-dedup, personal data, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written
as Parquet and read again as the next one's `docs`.  All but the last return the columns
of `documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm import lines, nearjoin, packing, pii, quality
from lodewell.llm.common import shared_dir


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` with n_chars as the text now has them."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails, go.

    A null or empty text has no words, so it fails and goes; a null host is no host.
    Long texts are read whole, equal rows are judged alike, an empty table stays empty.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another occurrence stands for go, and with them documents that have nothing else.

    Null and empty texts and rows with a null key stay as they are; of equal lines (ties)
    that of the least (key, row, position) stays; rows of equal key and text lose the same
    lines, rows of one key and unlike texts are documents of their own.  Long texts are read
    whole, an empty table stays empty.
    """
    left = lines.dedup_lines(docs, counts=("__lw_lines", "__lw_removed")).where("NOT (__lw_removed > 0 AND trim(text) = '')")
    return _measured(left, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the document with the least id stays.

    Rows with a null key or a text without a word stay; repeated rows stay or go together,
    rows of one key and unlike texts are judged each by its text.  Long texts are read
    whole, an empty table stays empty.
    """
    return nearjoin.keep_one(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become their kind in angle brackets.

    Null texts stay null, empty ones empty; the classifier learns from all rows given, so
    equal rows are treated alike; long texts are read whole, an empty table stays empty.
    """
    return _measured(pii.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, one row per piece, with its ids.

    A null or empty text is the end mark alone; long texts are cut over sequences, repeated
    rows are packed each, an empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", pack),
]

#: SQL expresses neither the classifier's spans nor BPE ids; a test compares each stage, on the one before it, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
