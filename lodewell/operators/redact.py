"""Claims checked against the evidence of other groups, and dropped where that explains them better."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import claims, pack_greedily, ratio, terms

#: (premise, hypothesis) -> number in [0, 1]
Scorer = Callable[[Column, Column], Column]


def overlap(premise: Column, hypothesis: Column) -> Column:
    """The default scorer: the share of the hypothesis' distinct terms that the premise has."""
    h = F.array_distinct(terms(hypothesis))
    return ratio(F.size(F.array_intersect(h, terms(premise))), F.size(h))


def _keys(case: str | Sequence[str]) -> list[str]:
    return [case] if isinstance(case, str) else list(case)


def extracted(answers: DataFrame, case: str | Sequence[str], fields: Sequence[str], fallback: str, lists: Sequence[str] = ()) -> DataFrame:
    """(case, field, position, claim): sentences of text fields and items of lists, fallbacks left out.

    A case is told by one column or several, as a conversation and a turn.
    """

    def numbered(field: str, items: Column) -> Column:
        return F.transform(items, lambda x, i: F.struct(F.lit(field).alias("field"), i.alias("position"), F.trim(x).alias("claim")))

    parts = [numbered(f, claims(F.coalesce(F.col(f), F.lit("")))) for f in fields]
    parts += [numbered(f, F.coalesce(F.col(f), F.array().cast("array<string>"))) for f in lists]
    rows = answers.select(*_keys(case), F.explode(F.concat(*parts)).alias("c")).select(*_keys(case), "c.*")
    return rows.where((F.col("claim") != "") & (F.col("claim") != fallback))


def premises(pool: DataFrame, case: str, group: str, selected: str, text: str, rank: str, most: int = 1800) -> DataFrame:
    """(case, own, other): evidence of the selected group and of the others, in rank order, packed into chunks."""
    ordered = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(rank, text)))), lambda x: x[text])
    mine = F.col(group) == F.col(selected)
    both = pool.groupBy(case).agg(ordered(mine).alias("o"), ordered(~mine).alias("x"))
    return both.select(case, pack_greedily(F.col("o"), most, joint="\n").alias("own"), pack_greedily(F.col("x"), most, joint="\n").alias("other"))


def entailed(chunks: Column, claim: Column, scorer: Scorer = overlap) -> Column:
    """The best score over chunks; 0 if there are none."""
    return F.coalesce(F.array_max(F.transform(chunks, lambda c: scorer(c, claim))), F.lit(0.0))


def scored(claim_rows: DataFrame, evidence: DataFrame, case: str, scorer: Scorer = overlap) -> DataFrame:
    both = claim_rows.join(evidence, case, "left")
    empty = F.array().cast("array<string>")
    return both.withColumns({"e_own": entailed(F.coalesce("own", empty), F.col("claim"), scorer), "e_other": entailed(F.coalesce("other", empty), F.col("claim"), scorer)}).drop("own", "other")


def scored_by_model(claim_rows: DataFrame, evidence: DataFrame, case: str, scorer: Scorer) -> DataFrame:
    """As `scored`, for scorers that are batch models: every chunk meets its case's claims as a row of its own.

    Claims without chunks score 0.  The maxima are taken by claim, so a case with many
    chunks is spread like any other rows.
    """
    side = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("side"), x.alias("chunk")))
    rows = claim_rows.join(evidence, case, "left").withColumn("_c", F.explode_outer(F.concat(side("own"), side("other")))).drop("own", "other")
    rows = rows.withColumn("_s", F.when(F.col("_c").isNotNull(), scorer(F.col("_c.chunk"), F.col("claim"))))
    best = lambda s: F.coalesce(F.max(F.when(F.col("_c.side") == s, F.col("_s"))), F.lit(0.0)).alias(f"e_{s}")
    return rows.groupBy(*claim_rows.columns).agg(best("own"), best("other"))


def dropped(threshold: float | Column, margin: float = 0.0) -> Column:
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    return (F.col("e_other") >= t) & (F.col("e_other") > F.col("e_own") + margin)


def rebuilt(claim_rows: DataFrame, case: str | Sequence[str], threshold: float, fallback: str, margin: float = 0.0) -> DataFrame:
    """(case, field, text, n_dropped): the claims that stay, in order; the fallback if none does."""
    d = dropped(threshold, margin)
    g = claim_rows.groupBy(*_keys(case), "field").agg(F.sort_array(F.collect_list(F.when(~d, F.struct("position", "claim")))).alias("k"), F.count_if(d).alias("n_dropped"))
    text = F.array_join(F.transform("k", lambda x: x["claim"]), " ")
    return g.select(*_keys(case), "field", F.when(text == "", F.lit(fallback)).otherwise(text).alias("text"), "n_dropped")


def calibrated(claim_rows: DataFrame, grid: Sequence[float], most: float = 0.10, default: float = 0.5, margin: float = 0.0) -> DataFrame:
    """The highest threshold of a written-out grid at which at most this share of claims is dropped."""
    rows = claim_rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    per = rows.groupBy("threshold").agg(F.avg(dropped(F.col("threshold"), margin).cast("double")).alias("rate"))
    return per.agg(F.coalesce(F.max(F.when(F.col("rate") <= most, F.col("threshold"))), F.lit(default)).alias("threshold"))
