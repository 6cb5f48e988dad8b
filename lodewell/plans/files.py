"""Queries that write with each sink into the shared folder and read back with each reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, retrieval as R
from ..shared import shared_dir
from ..sources import collections, readers, sinks, vectors
from .base import QRELS, qrels, table
from .retrieval import QUERIES as _RETRIEVAL


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


_DDL = "n_nationkey INT, n_name STRING, n_regionkey INT"
_COLS = ("n_nationkey", "n_name", "n_regionkey")


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def parquet_projected(spark: SparkSession, sf: str) -> DataFrame:
    at = _place(spark, "sink")
    sinks.parquet(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_comment" if "o_comment" in table(spark, sf, "orders").columns else "o_custkey"), at, "o_orderstatus")
    return readers.parquet(spark, at, ["o_orderkey", "o_orderstatus"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    at = _place(spark, "sink")
    sinks.csv(_nations(spark, sf).withColumn("n_name", F.concat(F.col("n_name"), F.lit(', "quoted"'))), at)
    return _typed(readers.csv(spark, at))


def csv_strings(spark: SparkSession, sf: str) -> DataFrame:
    at = _place(spark, "sink")
    sinks.csv(_nations(spark, sf).withColumn("n_regionkey", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey"))), at)
    return readers.csv_strings(spark, at).select(*_COLS)


def json_document(spark: SparkSession, sf: str) -> DataFrame:
    at = _place(spark, "sink")
    sinks.document(_nations(spark, sf), at)
    return _typed(readers.json_document(spark, at, _DDL))


def jsonl_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    """Good lines, lines with an error, broken and blank ones: the good come back."""
    at = _place(spark, "sink")
    good = F.to_json(F.struct(*_COLS))
    line = F.when(F.col("n_nationkey") % 5 == 0, F.lit("{broken")).when(F.col("n_nationkey") % 7 == 0, F.lit('{"n_nationkey": 1, "error": "late"}')).when(F.col("n_nationkey") % 11 == 0, F.lit("")).otherwise(good)
    _nations(spark, sf).select(line.alias("value")).write.text(at)
    return _typed(readers.jsonl_tolerant(spark, at, _DDL))


def jsonl_strict(spark: SparkSession, sf: str) -> DataFrame:
    at = _place(spark, "sink")
    sinks.jsonl(_nations(spark, sf), at)
    return _typed(readers.jsonl_strict(spark, at, _DDL))


def record_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Records by region folder, read with the folder's name as a column."""
    at = _place(spark, "sink")
    collections.register(spark)
    w = _nations(spark, sf).withColumn("part", F.concat(F.lit("r"), F.col("n_regionkey"))).write.format("record-files")
    w.option("path", at).option("key", "n_nationkey").option("folders", "part").mode("append").save()
    d = readers.path_parts(readers.json_directory(spark, at, _DDL), "folder", "stem")
    return d.groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.col("n_nationkey").cast("long")).alias("keys"), F.sum(F.col("stem").cast("long")).alias("names"))


def _collection(spark: SparkSession, sf: str) -> str:
    """The tables as a retrieval collection in the shared folder."""
    at = _place(spark, "collection")
    collections.register(spark)
    table(spark, sf, "documents").select("doc_id", "text").write.json(f"{at}/docs")
    table(spark, sf, "benchmark").select(F.concat_ws("\t", F.col("item_id").cast("string"), F.translate("text", "\t\n", "  "))).write.text(f"{at}/queries")
    qrels(spark, sf).select(F.concat(F.pmod("doc_id", F.lit(40)).cast("string"), F.lit(" 0 "), F.col("doc_id").cast("string"), F.lit(" "), F.col("rel").cast("string"))).write.text(f"{at}/qrels")
    return at


def _read_part(spark: SparkSession, at: str, part: str, columns: str = "") -> DataFrame:
    return spark.read.format("retrieval").option("path", at).option("part", part).option("columns", columns).load()


def collection_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _read_part(spark, _collection(spark, sf), "docs").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def collection_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements of a collection by query, with documents that it holds, of which only the ids are read."""
    at = _collection(spark, sf)
    held = _read_part(spark, at, "docs", "doc_id")
    asked = _read_part(spark, at, "queries")
    judged = _read_part(spark, at, "qrels").join(held, "doc_id").groupBy("query_id").agg(F.count("*").alias("judged"), F.count_if(F.col("rel") > 0).alias("relevant"))
    return asked.join(judged, "query_id", "left").select("query_id", F.length("text").cast("long").alias("n_chars"), "judged", "relevant")


def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """Exact dense search over vectors and ids written as NumPy files and read again."""
    at = _place(spark, "vectors")
    vectors.register(spark)
    table(spark, sf, "embeddings").select("vec_id", "embedding").write.format("npy-vectors").mode("append").save(at)
    e = spark.read.format("npy-vectors").load(at)
    return R.dense_top(e, e.where("vec_id % 50 = 0"), 20).select("query_id", "doc_id", "score")


def vector_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of written vectors, of which no number is read, by their last digit."""
    at = _place(spark, "vectors")
    vectors.register(spark)
    table(spark, sf, "embeddings").write.format("npy-vectors").mode("append").save(at)
    ids = spark.read.format("npy-vectors").option("columns", "vec_id").load(at)
    return ids.groupBy((F.col("vec_id") % 10).alias("digit")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def first_records(spark: SparkSession, sf: str) -> DataFrame:
    """The first five nations as one JSON document of records."""
    at = _place(spark, "sink")
    sinks.document(_nations(spark, sf).orderBy("n_nationkey").limit(5), at)
    return _typed(readers.json_document(spark, at, _DDL))


def append_log(spark: SparkSession, sf: str) -> DataFrame:
    """An append log resumed once: the second run adds only what the first had not done."""
    at = _place(spark, "log")
    work = _nations(spark, sf)
    sinks.append_new(work.where("n_regionkey < 2"), None, at, ["n_nationkey"])
    sinks.append_new(work, readers.jsonl_tolerant(spark, at, _DDL), at, ["n_nationkey"])
    return _typed(readers.jsonl_strict(spark, at, _DDL))


def log_compaction(spark: SparkSession, sf: str) -> DataFrame:
    at = _place(spark, "log")
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    sinks.compact(e, at, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error")
    return readers.jsonl_strict(spark, at, "user_id BIGINT, event_id BIGINT, event_type STRING").select("user_id", "event_id", "event_type")


def manifest_file(spark: SparkSession, sf: str) -> DataFrame:
    at = _place(spark, "manifest")
    rows = table(spark, sf, "supplier").select("s_suppkey", F.struct(F.col("s_nationkey").alias("clarity"), (F.col("s_nationkey") % 5).alias("safety")).alias("scores"), F.array(F.lit("a"), F.col("s_nationkey").cast("string")).alias("tags"))
    sinks.manifest(rows, at, "scores", "tags")
    return readers.csv(spark, at, "s_suppkey BIGINT, clarity BIGINT, safety BIGINT, tags STRING")


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    means = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity").cast("double"), 2).alias("q"))
    latex = sinks.latex_rows(means, ["l_returnflag", "q"], 2).select(F.lit("latex").alias("form"), "line")
    return latex.unionByName(sinks.markdown_rows(means, ["l_returnflag", "q"], 2).select(F.lit("markdown").alias("form"), "line"))


def several_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """One table to a file for each of several selections, written from one scan by partition."""
    at = _place(spark, "outputs")
    sinks.outputs(_nations(spark, sf), at, {"low": F.col("n_regionkey") < 2, "even": F.col("n_nationkey") % 2 == 0})
    return spark.read.json(at).groupBy("output").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


def configuration(spark: SparkSession, sf: str) -> DataFrame:
    """Orders under a bound that a written configuration sets, found behind a path that doesn't exist."""
    at = _place(spark, "config")
    half = F.max("o_totalprice").cast("double") / 2
    least = table(spark, sf, "orders").agg(F.round(half * 100) / 100).first()[0] or 0.0  # hundredths that end in a half go up, as in SQL
    sinks.summary({"least": least, "name": "half"}, at, spark)
    c = readers.config(spark, readers.first_existing(spark, [at + "-missing", at]))
    return table(spark, sf, "orders").where(F.col("o_totalprice") >= c["least"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.lit(c["name"]).alias("name"))


def file_checksums(spark: SparkSession, sf: str) -> DataFrame:
    at = _place(spark, "sink")
    _nations(spark, sf).select(F.concat_ws(",", "n_nationkey", "n_name").alias("value")).coalesce(1).sortWithinPartitions("value").write.text(at)
    files = readers.checksums(spark, at, ["_SUCCESS", ".crc"])
    return files.select(F.col("size").cast("long").alias("size"), "sha256")


def schema_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Columns by name whatever their case, types, and string columns of long text."""
    d = table(spark, sf, "documents")
    types, _ = corpus.preview(d)
    long = corpus.text_columns(d)
    rows = [(n, t, n in long, n == readers.sniffed(d, ["TEXT", "body"])) for n, t in types]
    return spark.createDataFrame(rows, "name string, type string, long boolean, sniffed boolean")


def bounded_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan that ends when a written-out number of rows is found: only that many are read on."""
    return readers.bounded(spark.read.parquet(f"{sf}/events.parquet").where("event_type <> 'error'"), 25).agg(F.count("*").alias("n"))


_N = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
QUERIES = {
    "vector_index": (vector_index, _RETRIEVAL["knn_exact"][1]),
    "vector_ids": (vector_ids, "SELECT vec_id % 10 AS digit, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings GROUP BY 1"),
    "first_records": (first_records, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation ORDER BY n_nationkey LIMIT 5"),
    "parquet_projected": (parquet_projected, "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1"),
    "csv_inferred": (csv_inferred, _N.replace("n_name,", "n_name || ', \"quoted\"' AS n_name,")),
    "csv_strings": (csv_strings, "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END AS n_regionkey FROM nation"),
    "json_document": (json_document, _N),
    "jsonl_tolerant": (jsonl_tolerant, _N + " WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AND n_nationkey % 11 <> 0"),
    "jsonl_strict": (jsonl_strict, _N),
    "record_directory": (record_directory, "SELECT 'part=r' || n_regionkey AS folder, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys, CAST(sum(n_nationkey) AS BIGINT) AS names FROM nation GROUP BY 1"),
    "collection_docs": (collection_docs, "SELECT doc_id, md5(text) AS digest FROM documents"),
    "collection_judged": (collection_judged, f"WITH qr AS ({QRELS}), j AS (SELECT doc_id % 40 AS query_id, count(*) AS judged, count(*) FILTER (rel > 0) AS relevant FROM qr JOIN documents USING (doc_id) GROUP BY 1) SELECT CAST(item_id AS BIGINT) AS query_id, length(text) AS n_chars, judged, relevant FROM benchmark LEFT JOIN j ON j.query_id = item_id"),
    "append_log": (append_log, _N),
    "log_compaction": (log_compaction, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1"),
    "manifest_file": (manifest_file, "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(s_nationkey AS BIGINT) AS clarity, CAST(s_nationkey % 5 AS BIGINT) AS safety, 'a;' || s_nationkey AS tags FROM supplier"),
    "report_rows": (report_rows, r"WITH m AS (SELECT l_returnflag AS f, printf('%.2f', round(CAST(avg(l_quantity) AS DOUBLE), 2)) AS q FROM lineitem GROUP BY 1) SELECT 'latex' AS form, f || ' & ' || q || ' \\' AS line FROM m UNION ALL SELECT 'markdown', '| ' || f || ' | ' || q || ' |' FROM m"),
    "several_outputs": (several_outputs, "SELECT 'low' AS output, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'even', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_nationkey % 2 = 0"),
    "configuration": (configuration, "SELECT o_orderstatus, count(*) AS n, 'half' AS name FROM orders WHERE o_totalprice >= (SELECT round(max(o_totalprice) / 2, 2) FROM orders) GROUP BY 1"),
    "file_checksums": (file_checksums, "WITH t AS (SELECT string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY CAST(n_nationkey AS VARCHAR) || ',' || n_name) AS x FROM nation) SELECT CAST(strlen(x) AS BIGINT) AS size, sha256(x) AS sha256 FROM t"),
    "schema_preview": (schema_preview, None),
    "bounded_scan": (bounded_scan, "SELECT least(25, count(*)) AS n FROM events WHERE event_type <> 'error'"),
}
