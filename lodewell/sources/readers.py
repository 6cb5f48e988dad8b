"""Scans: Parquet, CSV, JSON and JSONL in their tolerant and strict forms, directories, checksums, configuration."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def nan_as_null(df: DataFrame) -> DataFrame:
    """Missing numbers as nulls, as averages and extremes expect."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that aren't asked for are not read."""
    df = spark.read.parquet(path)
    return nan_as_null(df.select(*columns) if columns else df)


def csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A header, quoted fields that may span lines; types are inferred without a schema."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return nan_as_null((r.schema(schema) if schema else r.option("inferSchema", True)).csv(path))


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, empty cells as ''."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path).na.fill("")


def json_document(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """An object, or an array of them, per file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def _parsed(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def jsonl_tolerant(spark: SparkSession, path: str, schema: str | StructType, error: str = "error") -> DataFrame:
    """Lines that parse and carry no error; blank and broken ones are passed over."""
    own = _parsed(schema)
    extra = [f for f in (StructField(CORRUPT, StringType()), StructField(error, StringType())) if f.name not in own.names]
    wide = StructType([*own.fields, *extra])
    df = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df.where(F.col(CORRUPT).isNull() & F.col(error).isNull()).select(*own.names)


def jsonl_strict(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A broken line fails the read."""
    return spark.read.schema(_parsed(schema)).option("mode", "FAILFAST").json(path)


def json_directory(spark: SparkSession, path: str, schema: str | StructType, pattern: str = "*.json") -> DataFrame:
    """A record per file in all subfolders, files that don't parse passed over; `path_` is where each came from."""
    own = _parsed(schema)
    wide = StructType([*own.fields, StructField(CORRUPT, StringType())])
    r = spark.read.schema(wide).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("columnNameOfCorruptRecord", CORRUPT)
    df = r.json(path).select("*", F.col("_metadata.file_path").alias("path_"))
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def path_parts(df: DataFrame, *names: str, path: str = "path_") -> DataFrame:
    """Columns from the last parts of a path: folders, and the file's stem as the last."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/")
    return df.withColumns({n: F.url_decode(F.element_at(parts, i - len(names))) for i, n in enumerate(names)})


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path there is, looked up by Hadoop's file systems, so that any store will do."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(", ".join(paths))


def text_of(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def config(spark: SparkSession, path: str) -> dict:
    """A small JSON, or (if the library is there) YAML file."""
    text = text_of(spark, path)
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def checksums(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, size, sha256) of all files below, but those with an excluded part or ending in their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    for x in exclude:
        files = files.where(~F.contains("path", F.lit(x)))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """The first so many rows that the scan gives; it stops once it has them."""
    return df.limit(rows)


def sniffed(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first column called one of the names, whatever their case."""
    by_low = {c.lower(): c for c in df.columns}
    return next((by_low[n.lower()] for n in names if n.lower() in by_low), None)
