"""Ranking metrics, in the two families that must not be mixed: within the run, and against all judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio


def _keys(qrels: DataFrame) -> list[str]:
    """Judgements without `query_id` hold for every query alike; they are never copied for each."""
    return [c for c in ("query_id", "doc_id") if c in qrels.columns]


def graded(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with `rel`; what isn't judged has 0."""
    keys = _keys(qrels)
    return run.join(qrels.select(*keys, "rel"), keys, "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _gain(rel: Column, exponential: bool) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) if exponential else rel.cast("double")


def dcg(k: int, rel: str = "rel", rank: str = "rank", exponential: bool = True) -> Column:
    return F.sum(F.when(F.col(rank) <= k, _gain(F.col(rel), exponential) / F.log2(F.col(rank) + 1.0)).otherwise(0.0))


def run_metrics(run: DataFrame, k: int) -> DataFrame:
    """Per query: nDCG@k (exponential gain, the ideal being the run's own grades) and recall of the relevant documents in the run."""
    ideal = Window.partitionBy("query_id").orderBy(F.desc("rel"), F.asc("rank"))
    rows = run.withColumn("ideal_rank", F.row_number().over(ideal))
    out = rows.groupBy("query_id").agg(
        dcg(k).alias("_dcg"),
        dcg(k, rank="ideal_rank").alias("_ideal"),
        F.sum(((F.col("rel") > 0) & (F.col("rank") <= k)).cast("long")).alias("_hit"),
        F.sum((F.col("rel") > 0).cast("long")).alias("_all"),
    )
    return out.select("query_id", F.round(ratio(F.col("_dcg"), F.col("_ideal")), 6).alias("ndcg"), F.round(ratio(F.col("_hit"), F.col("_all")), 6).alias("recall"))


def judged_metrics(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query: nDCG@k (linear gain, ideal of the run's first k) and recall of all judged relevant documents."""
    top = graded(run, qrels).where(F.col("rank") <= k)
    top = top.withColumn("ideal_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), F.asc("rank"))))
    found = top.groupBy("query_id").agg(dcg(k, exponential=False).alias("_dcg"), dcg(k, rank="ideal_rank", exponential=False).alias("_ideal"), F.sum((F.col("rel") > 0).cast("long")).alias("_hit"))
    if "query_id" in qrels.columns:
        out = found.join(qrels.where("rel > 0").groupBy("query_id").agg(F.count("*").alias("_all")), "query_id", "left")
    else:
        out = found.withColumn("_all", F.lit(qrels.where("rel > 0").count()))
    return out.select("query_id", F.round(ratio(F.col("_dcg"), F.col("_ideal")), 6).alias("ndcg"), F.round(ratio(F.col("_hit"), F.coalesce("_all", F.lit(0))), 6).alias("recall"))


def macro(metrics: DataFrame, *names: str) -> DataFrame:
    """Means over queries."""
    return metrics.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def recall_ceiling(pool: DataFrame, qrels: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Mean and median share of a query's relevant documents that its pool holds, over queries that have any.

    Where judgements hold for every query, `queries(query_id)` names them.
    """
    pool = pool.select("query_id", "doc_id").distinct()
    if "query_id" in qrels.columns:
        hit = qrels.where("rel > 0").select("query_id", "doc_id").join(pool.withColumn("_in", F.lit(1)), ["query_id", "doc_id"], "left")
        per = hit.groupBy("query_id").agg(F.avg(F.coalesce("_in", F.lit(0)).cast("double")).alias("recall"))
    else:
        relevant = qrels.where("rel > 0").select("doc_id")
        hit = pool.join(relevant, "doc_id").groupBy("query_id").agg(F.count("*").alias("_n"))
        share = F.try_divide(F.coalesce("_n", F.lit(0)).cast("double"), F.lit(relevant.count()).cast("double"))
        per = queries.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", share.alias("recall")).where("recall IS NOT NULL")
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.expr("percentile(recall, 0.5)"), 6).alias("median_recall"))
