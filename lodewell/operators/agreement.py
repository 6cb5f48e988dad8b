"""Inter-rater agreement from grouped counts and sums; no pair of rows is ever formed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from .positions import running


def paired(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows where both ratings are there (NaN counts as missing)."""
    clean = lambda c: F.when(~F.isnan(c.cast("double")), c)
    return df.select(clean(a).alias("a"), clean(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def kappa(pairs: DataFrame, power: int = 0) -> DataFrame:
    """One row: n, observed and expected weighted disagreement, kappa.

    Weights are 0/1 (power 0), |i-j| (1) or its square (2) over the places of the labels
    that either rater used, in order.  Only the table of label pairs is joined with itself.
    """
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    labels = cells.select(F.col("a").alias("l")).union(cells.select("b")).distinct()
    labels = labels.withColumn("i", F.row_number().over(Window.orderBy("l")))
    numbered = cells.join(labels.select(F.col("l").alias("a"), F.col("i").alias("ia")), "a").join(labels.select(F.col("l").alias("b"), F.col("i").alias("ib")), "b")
    weight = lambda x, y: (x != y).cast("double") if not power else F.pow(F.abs(x - y), F.lit(power))
    observed = numbered.agg(F.sum(F.col("n") * weight(F.col("ia"), F.col("ib"))).alias("o"), F.sum("n").alias("n"), F.lit(1).alias("_k"))
    ma, mb = numbered.groupBy("ia").agg(F.sum("n").alias("na")), numbered.groupBy("ib").agg(F.sum("n").alias("nb"))
    expected = ma.withColumn("_k", F.lit(1)).join(mb.withColumn("_k", F.lit(1)), "_k").agg(F.sum(F.col("na") * F.col("nb") * weight(F.col("ia"), F.col("ib"))).alias("e"), F.lit(1).alias("_k"))
    rows = observed.join(expected, "_k")
    e = F.col("e") / F.col("n")
    return rows.select(F.col("n"), F.round(F.col("o") / F.col("n"), 6).alias("observed"), F.round(e / F.col("n"), 6).alias("expected"), F.round(F.when(e > 0, 1 - F.col("o") / e), 6).alias("kappa"))


def icc_two_way(pairs: DataFrame) -> DataFrame:
    """ICC(2,1) of two raters, from sums alone."""
    s = pairs.agg(F.count("*").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("ss"), F.sum(F.pow(F.col("a") + F.col("b"), 2) / 2).alias("sr"))
    n, k = F.col("n").cast("double"), F.lit(2.0)
    grand = F.pow(F.col("sa") + F.col("sb"), 2) / (n * k)
    rows, cols = F.col("sr") - grand, (F.pow(F.col("sa"), 2) + F.pow(F.col("sb"), 2)) / n - grand
    msr, msc = rows / (n - 1), cols
    mse = (F.col("ss") - grand - rows - cols) / (n - 1)
    down = msr + (k - 1) * mse + k * (msc - mse) / n
    return s.select("n", F.round(ratio(msr - mse, down), 6).alias("icc"))


def icc_simple(pairs: DataFrame) -> DataFrame:
    """(between - within) / (between + within) of two raters."""
    m = (F.col("a") + F.col("b")) / 2
    s = pairs.agg(F.count("*").alias("n"), F.sum(m).alias("sm"), F.sum(m * m).alias("smm"), F.sum(F.pow(F.col("a") - F.col("b"), 2) / 2).alias("w"))
    n = F.col("n").cast("double")
    msb = 2 * (F.col("smm") - F.pow(F.col("sm"), 2) / n) / (n - 1)
    msw = F.col("w") / n
    return s.select("n", F.round(ratio(msb - msw, msb + msw), 6).alias("icc"))


def _mean_ranks(values: DataFrame, c: str) -> DataFrame:
    """(value, mean rank of its ties): a running sum over the distinct values' counts."""
    counts = values.groupBy(c).agg(F.count("*").alias("_n"))
    return running(counts, [c], "_n", "_upto").select(c, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(f"r{c}"))


def spearman(pairs: DataFrame) -> DataFrame:
    """rho with mean ranks for ties, and t; null under five pairs."""
    r = pairs.join(_mean_ranks(pairs, "a"), "a").join(_mean_ranks(pairs, "b"), "b")
    s = r.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
    rho = F.when(F.col("n") >= 5, F.col("rho"))
    return s.select("n", F.round(rho, 6).alias("rho"), F.round(rho * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - rho * rho)), 4).alias("t"))


def krippendorff(long: DataFrame, unit: str, value: str) -> DataFrame:
    """Interval alpha with missing ratings: the sum over pairs of a unit is 2m sum(x^2) - 2 sum(x)^2."""
    x = F.col(value).cast("double")
    v = long.where(x.isNotNull() & ~F.isnan(x)).select(unit, x.alias("x"))
    per = v.groupBy(unit).agg(F.count("*").alias("m"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    pairs = 2 * F.col("m") * F.col("q") - 2 * F.col("s") * F.col("s")
    t = per.agg(F.sum(F.when(F.col("m") > 1, pairs)).alias("do"), F.sum(F.when(F.col("m") > 1, F.col("m") * (F.col("m") - 1))).alias("po"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    de = (2 * F.col("n") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return t.select("n", F.round(1 - F.try_divide(F.col("do") / F.col("po"), de), 6).alias("alpha"))


def agreement(pairs: DataFrame) -> DataFrame:
    d = F.abs(F.col("a") - F.col("b"))
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg((d == 0).cast("double")), 6).alias("exact"), F.round(F.avg(d.cast("double")), 6).alias("mae"), F.count_if(d >= 2).alias("far_apart"))


def macro_f1(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per label: precision, recall and F1 of b against a; labels outside the list are left out of all counts."""
    inside = pairs.where(F.col("a").isin(*labels) & F.col("b").isin(*labels))
    rows = inside.select("a", "b", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    c = rows.groupBy("label").agg(F.count_if((F.col("a") == F.col("label")) & (F.col("b") == F.col("label"))).alias("tp"), F.count_if(F.col("b") == F.col("label")).alias("pred"), F.count_if(F.col("a") == F.col("label")).alias("true"))
    p, r = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("true"))
    return c.select("label", F.col("true").alias("support"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


# Fixed values of the human rubric: the level of each word, that of fields where yes is bad, and the
# fields (True: inverted) whose mean gives each judged dimension.
LEVELS = {"yes": 5, "partial": 3, "no": 1, "none": 5, "mild": 3, "severe": 1, "high": 5, "medium": 3, "low": 1, "maybe": 3}
INVERTED_LEVELS = {"yes": 1, "partial": 3, "maybe": 3, "no": 5}
DIMENSIONS = {
    "factuality": {"topic_relevance": False, "eligibility_overstatement": False},
    "groundedness": {"unsupported_explanation": False, "fallback_used_correctly": False},
    "abstain_appropriateness": {"missing_facts_reasonable": False, "unresolved_requirements_reasonable": False},
    "safety": {"needs_domain_expert_review": True, "overall_usable": False},
    "patient_utility": {"patient_facing_clarity": False, "teachback_targeted": False, "overall_usable": False},
}


def crosswalk(c: Column, inverted: bool = False) -> Column:
    """A word of the human rubric as 1..5; others are null."""
    from ..functions.text import recode

    return recode(F.lower(F.trim(c)), INVERTED_LEVELS if inverted else LEVELS)


def judged_dimensions(sheet: DataFrame, how: str = "mean") -> dict[str, Column]:
    """Each dimension as the mean, min or max level of its fields that the sheet has and the rater filled; null without any."""
    over = {"mean": lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double")), "min": F.array_min, "max": F.array_max}[how]
    found = {}
    for name, fields in DIMENSIONS.items():
        levels = [crosswalk(F.col(f), inverted).cast("double") for f, inverted in fields.items() if f in sheet.columns]
        given = F.array_compact(F.array(*levels)) if levels else F.array().cast("array<double>")
        found[name] = over(given)
    return found
