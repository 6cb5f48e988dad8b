"""Tables of the driver, and views on them that several plans share, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, rel): quality plus one if not toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("rel"))


TOPICS = "SELECT CAST(item_id AS BIGINT) AS query_id, text FROM benchmark"
QRELS = "SELECT doc_id, CAST(quality + 1 - toxic AS INT) AS rel FROM labels"
#: BM25 top k of the topics over documents; text between [] is a parameter.
BM25 = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
dl AS (SELECT d.doc_id, len(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS dl FROM documents d),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
raw AS (SELECT term, ln((st.n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post, st GROUP BY term, st.n_docs),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
topics AS (""" + TOPICS + """),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM topics) GROUP BY 1, 2),
sc AS (SELECT q.query_id, post.doc_id, round(sum(q.qtf * idf.idf * post.tf * 2.5 / (post.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl))), 6) AS score
  FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl ON dl.doc_id = post.doc_id, st GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


def exact_interval(source: str, keys: str, steps: int = 45) -> str:
    """CTE `ci` (keys, k, n, lo, hi) for WITH RECURSIVE: the exact 95 % interval of k out of n, by halving on binomial tails."""
    tail = lambda over, at: f"list_sum(list_transform(range({over}), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({at}) + (n - i) * ln(1 - {at}))))"
    return f"""
bis AS (SELECT {keys}, k, n, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS d, 0 AS step FROM {source}
  UNION ALL SELECT {keys}, k, n, CASE WHEN up > 0.025 THEN a ELSE m END, CASE WHEN up > 0.025 THEN m ELSE b END, CASE WHEN low > 0.025 THEN w ELSE c END, CASE WHEN low > 0.025 THEN d ELSE w END, step + 1
  FROM (SELECT *, {tail("k, n + 1", "m")} AS up, {tail("0, k + 1", "w")} AS low FROM (SELECT *, (a + b) / 2 AS m, (c + d) / 2 AS w FROM bis WHERE step < {steps}))),
ci AS (SELECT {keys}, k, n, CASE WHEN k = 0 THEN 0 ELSE (a + b) / 2 END AS lo, CASE WHEN k = n THEN 1 ELSE (c + d) / 2 END AS hi FROM bis WHERE step = {steps})"""
