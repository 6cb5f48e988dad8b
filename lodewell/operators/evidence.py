"""Passage evidence rolled up to groups, selection signals, gates and candidate pools."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_scores(rows: DataFrame, case: str = "query_id", group: str = "doc_id", rank: str = "rank", cross: str = "cross", weights: tuple[float, float, float] = (0.45, 0.45, 0.10)) -> DataFrame:
    """Per case and group: n, best rank, sums of 1/(rank+1) and of scores shifted by the case's least, and their weighted score."""
    low = F.min(cross).over(Window.partitionBy(case))
    shifted = rows.withColumn("_shift", F.col(cross) - low + F.lit(1e-6)).withColumn("_rrf", 1.0 / (F.col(rank) + 1))
    out = shifted.groupBy(case, group).agg(
        F.count("*").alias("n_passages"),
        F.min(rank).alias("best_rank"),
        F.sum("_rrf").alias("sum_rrf"),
        F.sum("_shift").alias("sum_cross"),
        F.max("_shift").alias("max_cross"),
        F.sum(cross).alias("raw_sum_cross"),
        F.max(cross).alias("raw_max_cross"),
    )
    a, b, c = weights
    return out.withColumn("group_score", F.lit(a) * F.col("sum_rrf") + F.lit(b) * F.col("sum_cross") + F.lit(c) * F.col("n_passages"))


def selector_signals(scores: DataFrame, case: str = "query_id", group: str = "doc_id") -> DataFrame:
    """Per case: the first group, its score over the second's (at least 1e-6), its share, its best raw score and rank, the pool's size."""
    order = Window.partitionBy(case).orderBy(F.desc("group_score"), F.asc("best_rank"), F.asc(group))
    r = scores.withColumn("_rn", F.row_number().over(order))
    pick = lambda c, n: F.max(F.when(F.col("_rn") == n, F.col(c)))
    second = F.greatest(F.coalesce(pick("group_score", 2), F.lit(1e-6)), F.lit(1e-6))
    return r.groupBy(case).agg(
        pick(group, 1).alias("selected"),
        (pick("group_score", 1) / second).alias("dominance"),
        (pick("group_score", 1) / F.greatest(F.sum("group_score"), F.lit(1e-6))).alias("share"),
        pick("raw_max_cross", 1).alias("raw_max"),
        pick("best_rank", 1).alias("best_rank"),
        pick("n_passages", 1).alias("n_selected"),
        F.count("*").alias("n_groups"),
    )


def with_empty_pools(cases: DataFrame, signals: DataFrame, case: str = "query_id") -> DataFrame:
    """All cases; those without a pool get 0, 0, 0, 999, null and 0."""
    filled = {"dominance": 0.0, "share": 0.0, "raw_max": 0.0, "best_rank": 999, "n_selected": 0, "n_groups": 0}
    return cases.select(case).join(signals, case, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in filled.items()})


def gates(rho: float, tau: float, mu: float, kappa: int, generic: str | None = None) -> dict[str, Column]:
    """The named conditions of acceptance."""
    found = {"rho": F.col("dominance") >= rho, "tau": F.col("share") >= tau, "mu": F.col("raw_max") >= mu, "kappa": F.col("best_rank") <= kappa}
    return found | ({"generic": ~F.col(generic)} if generic else {})


def all_of(masks: Mapping[str, Column], without: str | None = None) -> Column:
    return reduce(lambda a, b: a & b, [m for k, m in masks.items() if k != without], F.lit(True))


def decision(signals: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    """accepted, status, and the first gate that failed."""
    failed = F.coalesce(*[F.when(~m, F.lit(k)) for k, m in masks.items()], F.lit("none"))
    ok = all_of(masks)
    return signals.withColumns({"accepted": ok, "status": F.when(ok, "accepted").otherwise("abstained"), "failed_gate": failed})


def single_group(rows: DataFrame, case: str = "query_id", group: str = "doc_id", rank: str = "rank", least_n: int = 3, least_share: float = 0.55, keep: int = 6) -> DataFrame:
    """Per case one group's rows: that with the largest share of 1/rank; abstains if it is weak and not alone.

    Weights are added up in order of rank, totals in order of the groups, so that the rows' own order decides nothing.
    """
    upto = Window.partitionBy(case, group).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = rows.withColumn("_weight", F.sum(1.0 / F.col(rank)).over(upto))
    per = added.groupBy(case, group).agg(F.max("_weight").alias("weight"), F.count("*").alias("n"), F.min(rank).alias("best_rank"))
    total = Window.partitionBy(case)
    order = total.orderBy(F.desc("weight"), F.desc("n"), F.asc("best_rank"), F.asc(group))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = per.withColumns({"share": F.col("weight") / F.sum("weight").over(whole), "n_groups": F.count("*").over(total), "_rn": F.row_number().over(order)}).where("_rn = 1")
    weak = (F.col("n") < least_n) | (F.col("share") < least_share)
    return top.select(case, F.col(group).alias("selected"), "share", "n", "n_groups", F.when(weak & (F.col("n_groups") > 1), "abstain").otherwise("accept").alias("status"), F.least("n", F.lit(keep)).alias("n_kept"))


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered anew."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= k)


def candidate_pool(rows: DataFrame, selected: DataFrame, case: str = "query_id", group: str = "doc_id", rank: str = "rank", groups: int = 4) -> DataFrame:
    """Best rows of the groups that weren't selected (ids compared without case), the first few groups of each case."""
    other = rows.join(selected.select(case, F.upper(F.col("selected").cast("string")).alias("_sel")), case).where(F.upper(F.col(group).cast("string")) != F.col("_sel"))
    best = first_rows(other, [case, group], [F.asc(rank)], 1).drop("position")
    return first_rows(best, [case], [F.asc(rank), F.asc(group)], groups).drop("_sel")


def priority(c: Column, order: Sequence[str], other: int = 9) -> Column:
    """Place in a list of names; what isn't in it comes last."""
    at = F.array_position(F.array(*[F.lit(s) for s in order]), c)
    return F.when(at > 0, at - 1).otherwise(F.lit(other).cast("long"))


def strata(signals: DataFrame, below: float = 1.5, deployed: float = 1.35, least: int = 2) -> DataFrame:
    """Two flags of each case with a contested pool: adversarial (dominance under `below`), accepted as deployed."""
    pool = F.col("n_groups") >= least
    return signals.withColumns({"is_adversarial": ((F.col("dominance") < below) & pool).cast("int"), "is_deployed_accept": ((F.col("dominance") >= deployed) & pool).cast("int")})


def baseline_evidence(rows: DataFrame, k: int, one_group: bool = False, case: str = "query_id", group: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The first k rows of each case, of all groups or of the first row's only, ranked anew as `position`; `reference` is that group."""
    first = F.first(group).over(Window.partitionBy(case).orderBy(F.asc(rank), F.asc(group)))
    rows = rows.withColumn("reference", first)
    if one_group:
        rows = rows.where(F.col(group) == F.col("reference"))
    return first_rows(rows, [case], [F.asc(rank), F.asc(group)], k)


def abstention_cost(cases: DataFrame, pool: DataFrame, case: str = "query_id", regime: str = "status", gold: str = "gold", flag: str = "relevant", member: str = "doc_id") -> DataFrame:
    """Per regime: cases, those for which something relevant was available (gold in the pool, or the flag), and the share.

    A case's pool is joined by case and gold at once, so only hits are kept.
    """
    hits = pool.select(case, F.col(member).alias(gold)).distinct().withColumn("_in", F.lit(True))
    rows = cases.join(hits, [case, gold], "left").withColumn("_ok", F.coalesce("_in", F.lit(False)) | F.coalesce(F.col(flag), F.lit(False)))
    out = rows.groupBy(regime).agg(F.count("*").alias("n"), F.count_if("_ok").alias("available"))
    return out.withColumn("rate", F.round(F.col("available") / F.col("n"), 6))
