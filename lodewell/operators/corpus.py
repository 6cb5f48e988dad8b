"""Building a text corpus: clean fields, labelled text, passages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pack_greedily, sentences, squash


def with_columns_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Missing columns added as empty text, all of them squashed."""
    return df.withColumns({n: squash(F.col(n)) if n in df.columns else F.lit("") for n in names})


def labelled_text(**fields: Column) -> Column:
    """`NAME: value` blocks joined by spaces."""
    parts = [F.concat(F.lit(f"{name.upper()}: "), value) for name, value in fields.items()]
    return F.trim(F.concat_ws(" ", *parts))


def passages(docs: DataFrame, sections: Sequence[str], key: str = "doc_id", most: int = 1200, least: int = 80, carry: Sequence[str] = ()) -> DataFrame:
    """One row per passage: passage_id `key::section::i`, doc_id, section, passage_text.

    Each section's sentences are packed up to `most` characters; one fold per row, so
    documents are never shuffled.
    """
    parts = F.array(*[F.struct(F.lit(s).alias("section"), pack_greedily(sentences(squash(F.col(s))), most, least).alias("texts")) for s in sections])
    rows = docs.select(F.col(key), *carry, F.explode(parts).alias("p"))
    rows = rows.select(F.col(key), *carry, "p.section", F.posexplode("p.texts").alias("i", "passage_text"))
    return rows.select(F.concat_ws("::", F.col(key).cast("string"), "section", F.col("i").cast("string")).alias("passage_id"), F.col(key), "section", F.col("i"), "passage_text", *carry)


def text_columns(df: DataFrame, least: float = 20.0) -> list[str]:
    """String columns whose mean length is over `least`, by one pass."""
    names = [n for n, t in df.dtypes if t == "string"]
    if not names:
        return []
    row = df.agg(*[F.avg(F.length(n)).alias(n) for n in names]).first()
    return [n for n in names if (row[n] or 0) > least]


def preview(df: DataFrame, rows: int = 5) -> tuple[list[tuple[str, str]], DataFrame]:
    return df.dtypes, df.limit(rows)
