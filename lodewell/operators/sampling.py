"""Deterministic samples, quotas, blinded orders, and resumable work lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blind_id, draw
from .positions import positioned


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of their key."""
    return df.withColumn("_d", draw(F.lit(seed), F.col(key))).orderBy("_d", key).limit(n).drop("_d")


def quotas(df: DataFrame, key: str, stratum: Column, sizes: Mapping[str, int], total: int, seed: int = 0) -> DataFrame:
    """So many rows of each stratum, then the next of any until there are `total`."""
    by_hash = [F.asc("_d"), F.asc(key)]
    rows = df.withColumn("stratum", stratum).withColumn("_d", draw(F.lit(seed), F.col(key)))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("stratum").orderBy(*by_hash)))
    quota = F.coalesce(*[F.when(F.col("stratum") == k, F.lit(v)) for k, v in sizes.items()], F.lit(0))
    rows = rows.withColumn("in_quota", F.col("_rn") <= quota)
    return rows.orderBy(F.desc("in_quota"), *by_hash).limit(total).drop("_d", "_rn")


def blinded(df: DataFrame, key: str, salt: str, n: int = 10) -> DataFrame:
    """blind_id, and the place in the order of presentation, by another hash."""
    d = df.withColumn("blind_id", blind_id(n, F.lit(salt), F.col(key)))
    return positioned(d.withColumn("_d", draw(F.lit(salt), F.lit("order"), F.col(key))), ["_d", key], "order").drop("_d")


def alternating(df: DataFrame, stratum: str, key: str) -> DataFrame:
    """Rows of the strata in turn, by hash within each."""
    r = df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(draw(F.col(key)), key)))
    return r.orderBy("turn", stratum)


def to_do(work: DataFrame, log: DataFrame, keys: Sequence[str], failed: Column | None = None) -> DataFrame:
    """Work without a successful line in the log."""
    done = log if failed is None else log.where(~failed)
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def compacted(log: DataFrame, keys: Sequence[str], order: Sequence[Column], failed: Column | None = None) -> DataFrame:
    """The last successful line of each key."""
    ok = log if failed is None else log.where(~failed)
    return ok.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
