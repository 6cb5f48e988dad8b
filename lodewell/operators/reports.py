"""Stratified rates, flags over raters, tags, melts and confusion counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio

#: Two published meanings of commit and abstain, by name.
DECISION_SETS = {
    "strict": {"commit": ("likely_match", "unlikely_match"), "abstain": ("cannot_determine", "possible_match")},
    "lenient": {"commit": ("likely_match", "possible_match"), "abstain": ("cannot_determine",)},
}


def without_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True)))


def rate(pred: Column) -> Column:
    return F.avg(pred.cast("int").cast("double"))


def rates(df: DataFrame, by: Sequence[str], named: Mapping[str, Column], digits: int = 6) -> DataFrame:
    """Rows and the share of each condition per group; null keys are left out."""
    return without_null_keys(df, *by).groupBy(*by).agg(F.count("*").alias("n"), *[F.round(rate(p), digits).alias(k) for k, p in named.items()])


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], named: Mapping[str, Column]) -> DataFrame:
    """One pass over several groupings; keys not in a grouping are null there."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("grouping"), *[c.alias(k) for k, c in named.items()])


def mean_of_means(df: DataFrame, by: Sequence[str], inner: Sequence[str], values: Sequence[str], digits: int = 6) -> DataFrame:
    """Means over raters first, then over cases."""
    first = df.groupBy(*by, *inner).agg(*[F.avg(v).alias(v) for v in values])
    return first.groupBy(*by).agg(F.count("*").alias("cases"), *[F.round(F.avg(v), digits).alias(v) for v in values])


def tag_shares(df: DataFrame, by: Sequence[str], tags: Column, case: str, rater: str) -> DataFrame:
    """Share of each tag in a group over its cases times its raters."""
    base = df.groupBy(*by).agg((F.countDistinct(case) * F.countDistinct(rater)).alias("_all"))
    tag = df.select(*by, F.explode(tags).alias("tag")).where("tag <> ''").groupBy(*by, "tag").agg(F.count("*").alias("n"))
    return tag.join(base, list(by)).select(*by, "tag", "n", F.round(ratio(F.col("n"), F.col("_all")), 6).alias("share"))


def rater_flags(df: DataFrame, by: Sequence[str], rater: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per rater (largest value), with any, both and their agreement; a rater that is missing stays null."""
    wide = df.groupBy(*by).pivot(rater, list(names)).agg(F.max(value))
    cols = [F.col(n) for n in names]
    return wide.withColumns({"any_flag": F.greatest(*cols), "all_flag": F.least(*cols), "n_raters": sum((c.isNotNull().cast("int") for c in cols), F.lit(0))})


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(i) for i in ids], [F.col(v) for v in values], name, value)


def confusion(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn with precision, recall and F1."""
    c = df.groupBy(*by).agg(F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"), F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * p * r, p + r), 6)})


def keep_one(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def row_mean(*cols: str) -> Column:
    """Mean over columns, nulls and NaN left out; null if none is left."""
    clean = [F.when(~F.isnan(c), F.col(c).cast("double")) for c in cols]
    n = sum((c.isNotNull().cast("int") for c in clean), F.lit(0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in clean), F.lit(0.0)), n)


def aligned(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of two manifests: only in one, equal in both, or different."""
    a, b = left.select(key, F.col(value).alias("_l")), right.select(key, F.col(value).alias("_r"))
    state = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.col("_l") == F.col("_r"), "same").otherwise("different")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def by_list(c: Column, names: Sequence[str]) -> Column:
    """Sort key by the place in a list; others last."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), c)
    return F.when(at > 0, at).otherwise(F.lit(len(names) + 1).cast("long"))


def histogram(df: DataFrame, x: Column, low: float, width: float, bins: int) -> DataFrame:
    """Counts in equal bins, values outside in the end bins, empty bins left out."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - low) / width).cast("int")))
    return df.select(at.cast("long").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def any_of(columns: Sequence[str], value: object) -> Column:
    """Whether any of the columns holds the value; null counts as no."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c) == F.lit(value), F.lit(False))
    return found


def by_rank_or_score(df: DataFrame, rank: str = "rank", score: str = "score") -> list[Column]:
    """The order that a run has: by its rank column if there is one, else by falling score."""
    return [F.asc(rank)] if rank in df.columns else [F.desc(score)]


def undefined_reasons(df: DataFrame, metrics: dict[str, tuple[Column, str]]) -> DataFrame:
    """(metric, n, undefined, reason): rows where each metric's value is null or NaN, and why it can be."""
    bad = lambda c: F.coalesce(F.isnan(c.cast("double")), F.lit(True)) | c.isNull()
    one = df.agg(F.count("*").alias("n"), *[F.count_if(bad(c)).alias(m) for m, (c, _) in metrics.items()])
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("n"), F.col(m).alias("undefined"), F.lit(why).alias("reason")) for m, (_, why) in metrics.items()])
    return one.select(F.explode(parts).alias("r")).select("r.*")
