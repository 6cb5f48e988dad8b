"""Threshold grids, Pareto fronts and leave-one-out ablation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ratio
from .positions import running


def grid(spark: SparkSession, rho: Sequence[float], tau: Sequence[float], mu: Sequence[float], kappa: Sequence[int]) -> DataFrame:
    """All settings, numbered; as many rows as the product of the lists, which the caller writes out."""
    rows = [(i, float(r), float(t), float(m), int(k)) for i, (r, t, m, k) in enumerate(product(rho, tau, mu, kappa))]
    return spark.createDataFrame(rows, "config long, rho double, tau double, mu double, kappa int")


def evaluate(signals: DataFrame, settings: DataFrame, relevant: Column, generic: Column) -> DataFrame:
    """Per setting: accepted, precision, recall, F1, unsafe accepts, share of generic cases that abstain.

    A case passes a gate at the first so many of its thresholds, in order, so a case is
    told by four such numbers and two flags.  Cases are counted by these, which is the only
    pass over them and its only shuffle; the settings, a list written out by the caller,
    meet the counts, whose number depends on the thresholds alone.
    """
    rows = settings.collect()
    rho, tau, mu = (sorted({r[c] for r in rows}) for c in ("rho", "tau", "mu"))
    kappa = sorted({r["kappa"] for r in rows}, reverse=True)
    passed = lambda tests: sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    cell = signals.select(
        passed(F.col("dominance") >= x for x in rho).alias("_r"),
        passed(F.col("share") >= x for x in tau).alias("_t"),
        passed(F.col("raw_max") >= x for x in mu).alias("_m"),
        passed(F.col("best_rank") <= x for x in kappa).alias("_k"),
        relevant.cast("int").alias("_rel"),
        generic.cast("int").alias("_gen"),
    )
    counts = cell.groupBy("_r", "_t", "_m", "_k", "_rel", "_gen").agg(F.count("*").alias("_n"))
    need = settings.sparkSession.createDataFrame(
        [(r["config"], r["rho"], r["tau"], r["mu"], r["kappa"], rho.index(r["rho"]) + 1, tau.index(r["tau"]) + 1, mu.index(r["mu"]) + 1, kappa.index(r["kappa"]) + 1) for r in rows],
        "config long, rho double, tau double, mu double, kappa int, _nr int, _nt int, _nm int, _nk int",
    )
    met = F.broadcast(need).crossJoin(counts)  # a grid by at most (thresholds + 1) to the fourth times four cells
    ok = ((F.col("_r") >= F.col("_nr")) & (F.col("_t") >= F.col("_nt")) & (F.col("_m") >= F.col("_nm")) & (F.col("_k") >= F.col("_nk")) & (F.col("_gen") == 0)).cast("int") * F.col("_n")
    c = met.withColumn("_ok", ok).groupBy("config", "rho", "tau", "mu", "kappa").agg(
        F.sum("_ok").alias("accepted"),
        F.sum(F.col("_ok") * F.col("_rel")).alias("tp"),
        F.sum(F.col("_n") * F.col("_rel")).alias("positives"),
        F.sum(F.col("_ok") * (1 - F.col("_rel"))).alias("unsafe"),
        F.sum(F.col("_n") * F.col("_gen")).alias("generic"),
        F.sum(F.col("_gen") * (F.col("_n") - F.col("_ok"))).alias("generic_abstained"),
    )
    p, r = ratio(F.col("tp"), F.col("accepted")), ratio(F.col("tp"), F.col("positives"))
    c = c.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * p * r, p + r), 6), "unsafety": F.round(ratio(F.col("unsafe"), F.col("accepted")), 6)})
    return c.withColumn("generic_abstain_rate", F.round(ratio(F.col("generic_abstained"), F.col("generic")), 6))


def pareto(points: DataFrame, up: str, down: str) -> DataFrame:
    """Rows that none is at least as good as in both and better in one; `up` is maximised, `down` minimised.

    By a running maximum over distinct values of `down`: a row stays if its `up` is the
    best at its `down` and above all best at smaller ones.  Only distinct (down, best up)
    pairs are put in order, by ranges; a range passes on its own best, no more, so a
    front of any size is found by many tasks.  Ties stay; a null is no value.
    """
    best = points.where(F.col(up).isNotNull() & F.col(down).isNotNull()).groupBy(down).agg(F.max(up).alias("_best"))
    front = running(best, [down], "_best", "_before", "max", own=False).where(F.col("_before").isNull() | (F.col("_best") > F.col("_before")))
    return points.join(front.select(down, F.col("_best").alias(up)), [down, up], "left_semi")


def best_row(points: DataFrame, *order: Column) -> DataFrame:
    return points.orderBy(*order).limit(1)


def leave_one_out(signals: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """(variant, case columns): cases accepted by all gates (`all`) and with each gate left out (`no_<gate>`), one pass."""
    from .evidence import all_of

    tags = [F.when(all_of(masks), F.lit("all"))] + [F.when(all_of(masks, k), F.lit(f"no_{k}")) for k in masks]
    return signals.withColumn("variant", F.explode(F.array_compact(F.array(*tags))))
