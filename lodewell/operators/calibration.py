"""Calibration of scores in [0, 1], and logistic recalibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Upper edges of ten equal bins as the doubles k * 0.1: 0.3, 0.6 and 0.7 fall below their edges.
_EDGES = tuple(k * 0.1 for k in range(1, 10))


def bin_of(p: Column) -> Column:
    """Bin 0..9 by comparing with the edges, not by multiplying."""
    return sum(((p >= F.lit(e)).cast("long") for e in _EDGES), F.lit(0).cast("long"))


def bins(df: DataFrame, p: Column, y: Column) -> DataFrame:
    """All ten bins: n, mean score, share of positives, absolute gap; empty bins have n = 0 and nulls."""
    got = df.select(bin_of(p).alias("bin"), p.alias("p"), y.cast("double").alias("y")).where("p IS NOT NULL AND y IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    every = df.sparkSession.range(10).withColumnRenamed("id", "bin")
    out = every.join(got, "bin", "left")
    return out.select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round("mp", 6).alias("mean_p"), F.round("my", 6).alias("mean_y"), F.round(F.abs(F.col("mp") - F.col("my")), 6).alias("gap"))


def expected_error(df: DataFrame, p: Column, y: Column) -> DataFrame:
    b = bins(df, p, y)
    return b.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))) / F.sum("n"), 5).alias("ece"))


def brier(df: DataFrame, p: Column, y: Column) -> DataFrame:
    """Brier score, that of the base rate, and the skill score (null where the base rate is 0 or 1)."""
    s = df.select(p.alias("p"), y.cast("double").alias("y")).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg("y").alias("base"))
    naive = F.col("base") * (1 - F.col("base"))
    return s.select("n", F.round("brier", 6).alias("brier"), F.round(naive, 6).alias("naive"), F.round(F.when((F.col("base") > 0) & (F.col("base") < 1), 1 - F.try_divide(F.col("brier"), naive)), 6).alias("skill"))


#: Newton steps at most; each is one aggregation over the rows.
STEPS = 50


def fitted(rows: DataFrame, features: Sequence[str], label: str, fold: str, k: int, c: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, deviations) of k logistic models, each of all rows but its own fold's, fitted together.

    Summed loss with strength `c` and no penalty on the intercept, on features scaled by
    the population deviations of a model's training rows.  A step of Newton's method
    needs each model's gradient and Hessian; a task sums these over its rows and returns
    one row of numbers, whatever it holds.  Rows with a null feature or label are left
    out; a model without rows has zero weights.
    """
    d = len(features)
    table = written(rows.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("f")).dropna(), "folds")
    sums = table.groupBy("f").agg(F.count("*").alias("n"), *[g.alias(f"{name}{i}") for i in range(d) for name, g in (("s", F.sum(f"x{i}")), ("q", F.sum(F.col(f"x{i}") * F.col(f"x{i}"))))]).collect()
    own = {r["f"]: r for r in sums}
    n = np.array([sum(r["n"] for f, r in own.items() if f != m) for m in range(k)], float)
    part = lambda name: np.array([[sum(r[f"{name}{i}"] for f, r in own.items() if f != m) for i in range(d)] for m in range(k)])
    mean = part("s") / np.maximum(n, 1)[:, None]
    deviation = np.sqrt(np.maximum(part("q") / np.maximum(n, 1)[:, None] - mean * mean, 0.0))
    deviation[deviation <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
    weights = np.zeros((k, d + 1))
    for _ in range(STEPS):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            gradient, hessian = np.zeros((k, d + 1)), np.zeros((k, d + 1, d + 1))
            for b in batches:
                x = np.stack([b.column(f"x{i}").to_numpy() for i in range(d)], 1)
                y, f = b.column("y").to_numpy(), b.column("f").to_numpy()
                for m in range(k):
                    at = f != m
                    z = np.column_stack([(x[at] - mean[m]) / deviation[m], np.ones(at.sum())])
                    p = 1 / (1 + np.exp(-np.clip(z @ weights[m], -500, 500)))
                    gradient[m] += z.T @ (y[at] - p)
                    hessian[m] += (z * (p * (1 - p))[:, None]).T @ z
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gradient.ravel(), hessian.ravel()]).tolist()], pa.list_(pa.float64()))], names=["v"])

        got = table.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(k * (d + 1) * (d + 2))
        for r in got:
            flat[r["i"]] = r["v"]
        gradient, hessian = flat[: k * (d + 1)].reshape(k, d + 1), flat[k * (d + 1) :].reshape(k, d + 1, d + 1)
        ridge = np.append(np.full(d, 1 / c), 0.0)
        step = np.stack([np.linalg.lstsq(hessian[m] + np.diag(ridge), gradient[m] - ridge * weights[m], rcond=None)[0] for m in range(k)])
        weights = weights + step
        if np.abs(step).max() < 1e-10:
            break
    return weights, mean, deviation


def probability(model: int, fit: tuple[np.ndarray, np.ndarray, np.ndarray], features: Sequence[str]) -> Column:
    """The chance that a model of `fitted` gives, as a Column."""
    weights, mean, deviation = fit
    z = F.lit(float(weights[model][-1]))
    for i, f in enumerate(features):
        z = z + F.lit(float(weights[model][i])) * (F.col(f).cast("double") - F.lit(float(mean[model][i]))) / F.lit(float(deviation[model][i]))
    return 1 / (1 + F.exp(-z))


def logistic(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, keep: Sequence[str], c: float = 1.0) -> DataFrame:
    """Test rows with `p`, from a logistic model on standardised features (`fitted`)."""
    fit = fitted(train.withColumn("_fold", F.lit(-1)), features, label, "_fold", 1, c)
    return test.select(*keep, F.round(probability(0, fit, features), 4).alias("p"))


def folds(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """A fold for each row by the MD5 of its key."""
    from ..functions.text import draw

    return df.withColumn("fold", F.pmod(draw(F.col(key)), F.lit(k)).cast("int"))


def cross_validated(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, c: float = 1.0) -> DataFrame:
    """(fold, n, brier) of each fold whose training rows and own rows hold both classes; others are skipped.

    All folds are fitted together, then scored in one pass.
    """
    rows = folds(df, key, k)
    sizes = {r["fold"]: (r["n"], r["y"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("y")).collect()}
    n, y = sum(a for a, _ in sizes.values()), sum(b for _, b in sizes.values())
    kept = [f for f, (m, z) in sizes.items() if 0 < z < m and 0 < y - z < n - m]
    if not kept:
        return df.sparkSession.createDataFrame([], "fold int, n long, brier double")
    fit = fitted(rows, features, label, "fold", k, c)
    p = F.coalesce(*[F.when(F.col("fold") == f, F.round(probability(f, fit, features), 4)) for f in kept])
    error = F.pow(p - F.col(label).cast("double"), 2)
    return rows.where(F.col("fold").isin(kept)).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(error), 6).alias("brier"))


def fold_summary(scores: DataFrame, value: str = "brier") -> DataFrame:
    """Folds, mean and population deviation."""
    return scores.agg(F.count("*").alias("folds"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("deviation"))
