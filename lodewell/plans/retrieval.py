"""Queries of retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ireval, retrieval as R
from .base import BM25, QRELS, qrels, table, topics


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    run = R.bm25(table(spark, sf, "documents"), topics(spark, sf), 10)
    return run.select("query_id", "doc_id", "score", F.col("rank").cast("long"))


def _run(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return R.bm25(table(spark, sf, "documents"), topics(spark, sf), k)


def ir_metrics_run(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf, 100).join(qrels(spark, sf), "doc_id", "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return ireval.run_metrics(run, 10)


def ir_metrics_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return ireval.judged_metrics(_run(spark, sf, 100), qrels(spark, sf), 10)


def ir_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ireval.macro(ir_metrics_run(spark, sf), "ndcg", "recall")


def recall_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return ireval.recall_ceiling(_run(spark, sf, 100), qrels(spark, sf), topics(spark, sf))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts and titles, a text's first line, as two fields of one index."""
    docs = table(spark, sf, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    ix = R.index(docs, topics(spark, sf), {"all": "text", "title": "title"})
    out = R.fused([R.search(ix, 100, "all"), R.search(ix, 100, "title", k1=0.9, b=0.4)], 20)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long"))


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return R.dense_top(e, e.where("vec_id % 50 = 0"), 20).select("query_id", "doc_id", "score")


def knn_eval(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    run = R.dense_top(e, e.where("vec_id % 50 = 0"), 50)
    label = e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("l"))
    rows = run.join(label, "doc_id").join(label.select(F.col("doc_id").alias("query_id"), F.col("l").alias("ql")), "query_id")
    return rows.groupBy("query_id").agg(F.sum((F.col("l") == F.col("ql")).cast("long")).alias("same_label"), F.round(F.avg("score"), 4).alias("mean_score"))


def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    out = R.reranked(_run(spark, sf, 50), topics(spark, sf), table(spark, sf, "documents"), k=10)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long"))


def coverage_diag(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf, 100).select("query_id", "doc_id")
    judged = qrels(spark, sf).withColumnRenamed("doc_id", "jid")
    sizes = run.groupBy("query_id").agg(F.count("*").alias("n"))
    a = sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean_n"), F.lit(1).alias("_k"))
    ids = run.select("doc_id").distinct()
    b = ids.join(judged, ids.doc_id == judged.jid, "left").agg(F.count("*").alias("pool_docs"), F.count("jid").alias("judged_docs"), F.lit(1).alias("_k"))
    return a.join(b, "_k").drop("_k")


def gold_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of the shortest document that each topic finds, in its full ranking."""
    run = R.bm25(table(spark, sf, "documents"), topics(spark, sf))
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return run.join(docs, "doc_id").groupBy("query_id").agg(F.min_by("rank", F.struct("n_chars", "doc_id")).cast("long").alias("gold_rank"), F.count("*").alias("found"))


def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    post = R.postings(table(spark, sf, "documents"))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 50")


_METRICS = BM25 + """,
qr AS (""" + QRELS + """),
run AS (SELECT bm.*, coalesce(qr.rel, 0) AS rel FROM bm LEFT JOIN qr USING (doc_id) WHERE rank <= 100),
idl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ir FROM run),
agg AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, rel) - 1) / log2(rank + 1.0) ELSE 0 END) AS d, sum(CASE WHEN ir <= 10 THEN (pow(2, rel) - 1) / log2(ir + 1.0) ELSE 0 END) AS i,
  sum(CASE WHEN rel > 0 AND rank <= 10 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS a FROM idl GROUP BY 1),
met AS (SELECT query_id, round(CASE WHEN i = 0 THEN 0 ELSE d / i END, 6) AS ndcg, round(CASE WHEN a = 0 THEN 0 ELSE h / a END, 6) AS recall FROM agg)"""

QUERIES = {
    "bm25_topk": (bm25_topk, "WITH " + BM25 + " SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10"),
    "ir_metrics_run": (ir_metrics_run, "WITH " + _METRICS + " SELECT * FROM met"),
    "ir_summary": (ir_summary, "WITH " + _METRICS + " SELECT count(*) AS n_queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall FROM met"),
    "ir_metrics_qrels": (ir_metrics_qrels, "WITH " + BM25 + ", qr AS (" + QRELS + """),
run AS (SELECT bm.*, coalesce(qr.rel, 0) AS rel FROM bm LEFT JOIN qr USING (doc_id) WHERE rank <= 10),
idl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ir FROM run),
agg AS (SELECT query_id, sum(rel / log2(rank + 1.0)) AS d, sum(rel / log2(ir + 1.0)) AS i, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS h FROM idl GROUP BY 1)
SELECT query_id, round(CASE WHEN i = 0 THEN 0 ELSE d / i END, 6) AS ndcg, round(h / (SELECT count(*) FROM qr WHERE rel > 0), 6) AS recall FROM agg"""),
    "recall_ceiling": (recall_ceiling, "WITH " + BM25 + ", qr AS (" + QRELS + """),
per AS (SELECT t.query_id, avg(CASE WHEN bm.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS recall FROM topics t CROSS JOIN (SELECT * FROM qr WHERE rel > 0) j
  LEFT JOIN bm ON bm.query_id = t.query_id AND bm.doc_id = j.doc_id AND bm.rank <= 100 GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, round(quantile_cont(recall, 0.5), 6) AS median_recall FROM per"""),
    "rrf_fusion": (rrf_fusion, "WITH two AS (WITH " + BM25 + " SELECT query_id, doc_id, rank FROM bm WHERE rank <= 100), head AS (WITH " + BM25.replace("documents", "(SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents)").replace("2.5 / (post.tf + 1.5 * (1 - 0.75 + 0.75 *", "1.9 / (post.tf + 0.9 * (1 - 0.4 + 0.4 *") + """ SELECT query_id, doc_id, rank FROM bm WHERE rank <= 100),
fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM two UNION ALL SELECT * FROM head) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu)
SELECT query_id, doc_id, score, rank FROM rk WHERE rank <= 20"""),
    "knn_exact": (knn_exact, """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.v, d.v), 6) AS score FROM n q JOIN n d ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score FROM r WHERE rank <= 20"""),
    "knn_eval": (knn_eval, """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
s AS (SELECT q.vec_id AS query_id, q.label AS ql, d.label AS l, d.vec_id AS doc_id, round(list_dot_product(q.v, d.v), 6) AS score FROM n q JOIN n d ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(sum(CASE WHEN l = ql THEN 1 ELSE 0 END) AS BIGINT) AS same_label, round(avg(score), 4) AS mean_score FROM r WHERE rank <= 50 GROUP BY 1"""),
    "rerank_topk": (rerank_topk, "WITH " + BM25 + """,
c AS (SELECT bm.query_id, bm.doc_id, bm.rank AS fr, list_distinct(regexp_extract_all(lower(t.text), '[a-z0-9]+')) AS q, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS d
  FROM bm JOIN topics t USING (query_id) JOIN documents d ON d.doc_id = bm.doc_id WHERE bm.rank <= 50),
s AS (SELECT query_id, doc_id, fr, round(len(list_intersect(q, d)) / len(q), 6) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10"""),
    "coverage_diag": (coverage_diag, "WITH " + BM25 + ", run AS (SELECT query_id, doc_id FROM bm WHERE rank <= 100), qr AS (" + QRELS + """),
z AS (SELECT count(*) AS n FROM run GROUP BY query_id), i AS (SELECT DISTINCT doc_id FROM run)
SELECT (SELECT min(n) FROM z) AS least, (SELECT max(n) FROM z) AS most, (SELECT round(avg(n), 6) FROM z) AS mean_n, count(*) AS pool_docs, count(qr.doc_id) AS judged_docs FROM i LEFT JOIN qr ON qr.doc_id = i.doc_id"""),
    "gold_rank": (gold_rank, "WITH " + BM25 + """, o AS (SELECT bm.query_id, bm.rank, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, bm.doc_id) AS rn, count(*) OVER (PARTITION BY query_id) AS found FROM bm JOIN documents d ON d.doc_id = bm.doc_id)
SELECT query_id, rank AS gold_rank, found FROM o WHERE rn = 1"""),
    "term_statistics": (term_statistics, "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 50"),
}
