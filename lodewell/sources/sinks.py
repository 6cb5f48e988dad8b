"""Sinks: tables, documents, records by partition, append logs that can be resumed, manifests and report text."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import compacted, to_do


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def parquet(df: DataFrame, path: str, *partition: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def jsonl(df: DataFrame, path: str, *partition: str, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition) if partition else w).json(path)


def document(df: DataFrame, path: str) -> None:
    """A bounded result as one JSON array of records."""
    rows = df.select(F.to_json(F.struct("*")).alias("r")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("r")), ","), F.lit("]")).alias("value"))
    rows.write.mode("overwrite").text(path)


def append_new(work: DataFrame, log: DataFrame | None, path: str, keys: Sequence[str], failed: Column | None = None) -> None:
    """Work that the log has no success of, appended to it: a second run adds nothing."""
    (work if log is None else to_do(work, log, keys, failed)).write.mode("append").json(path)


def compact(log: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], failed: Column | None = None) -> None:
    """The last success of each key, written beside the log (a path cannot be read and replaced at once)."""
    compacted(log, keys, order, failed).write.mode("overwrite").json(path)


def manifest(df: DataFrame, path: str, nested: str, tags: str) -> None:
    """Scored lines flattened: the nested scores as columns, tags joined by semicolons."""
    csv(df.select(*[c for c in df.columns if c not in (nested, tags)], f"{nested}.*", F.array_join(tags, ";").alias(tags)), path)


def latex_rows(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """A text column `line` with the cells of a table row."""
    kinds = dict(df.dtypes)
    cells = [F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))


def markdown_rows(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """A text column `line` with the cells of a Markdown table's row."""
    kinds = dict(df.dtypes)
    cells = [F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def outputs(df: DataFrame, path: str, selections: dict[str, Column]) -> None:
    """A JSONL folder `output=name` for each selection of rows, all from one scan."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in selections.items()]))
    df.withColumn("output", F.explode(names)).write.mode("overwrite").partitionBy("output").json(path)


def summary(values: dict, path: str, spark) -> None:
    """A small dictionary as one JSON file."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
