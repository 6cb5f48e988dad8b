"""Queries of agreement, resampling, calibration and exact intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import t_two_sided, with_interval
from ..operators import agreement as A, calibration as C
from ..operators.resample import MODULUS, MULTIPLIERS, REACH, bootstrap
from .base import exact_interval, table


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    a = (F.col("l_quantity") % 5 + 1).cast("int")
    return A.paired(li, a, F.when(F.col("l_partkey") % 3 == 0, a).otherwise((F.col("l_partkey") % 5 + 1).cast("int")))


_P = "p AS (SELECT CAST(l_quantity % 5 + 1 AS INT) AS a, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_quantity % 5 + 1 AS INT) ELSE CAST(l_partkey % 5 + 1 AS INT) END AS b FROM lineitem)"


def _kappa(power: int):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return A.kappa(_pairs(spark, sf), power)

    w = lambda x, y: f"CAST({x} <> {y} AS INT)" if not power else f"pow(abs({x} - {y}), {power})"
    sql = f"""WITH {_P}, c AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), l AS (SELECT l, row_number() OVER (ORDER BY l) AS i FROM (SELECT a AS l FROM c UNION SELECT b FROM c)),
 k AS (SELECT la.i AS ia, lb.i AS ib, n FROM c JOIN l la ON la.l = a JOIN l lb ON lb.l = b), o AS (SELECT sum(n * {w('ia', 'ib')}) AS o, sum(n) AS n FROM k),
 e AS (SELECT sum(x.n * y.n * {w('x.i', 'y.i')}) AS e FROM (SELECT ia AS i, sum(n) AS n FROM k GROUP BY 1) x, (SELECT ib AS i, sum(n) AS n FROM k GROUP BY 1) y)
 SELECT CAST(n AS BIGINT) AS n, round(o / n, 6) AS observed, round(e / n / n, 6) AS expected, round(CASE WHEN e > 0 THEN 1 - o / (e / n) END, 6) AS kappa FROM o, e"""
    return q, sql


def icc21(spark: SparkSession, sf: str) -> DataFrame:
    return A.icc_two_way(_pairs(spark, sf))


def icc_simple(spark: SparkSession, sf: str) -> DataFrame:
    return A.icc_simple(_pairs(spark, sf))


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return A.spearman(_pairs(spark, sf)).select("n", "rho")


def spearman_p(spark: SparkSession, sf: str) -> DataFrame:
    s = A.spearman(_pairs(spark, sf))
    return s.select("n", "rho", F.round(t_two_sided(F.col("t"), (F.col("n") - 2).cast("double")), 8).alias("p"))


def krippendorff(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity") % 5 + 1).alias("x"))
    return A.krippendorff(li, "l_orderkey", "x")


def exact_mae(spark: SparkSession, sf: str) -> DataFrame:
    return A.agreement(_pairs(spark, sf))


def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_partkey") % 4 == 0, "A").when(F.col("l_partkey") % 4 == 1, "R").otherwise(F.col("l_returnflag")).alias("b"))
    return A.macro_f1(e, ["A", "N", "R"])


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_nationkey").cast("double")).alias("nation"))
    return bootstrap(c, "s_suppkey", ["balance", "nation"])


def bootstrap_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Five ratings of each case, some missing, under the same 5000 draws."""
    c = table(spark, sf, "customer")
    rating = lambda m: F.when(F.col("c_custkey") % (m + 7) > 0, ((F.col("c_custkey") * m + F.col("c_nationkey")) % 5 + 1).cast("double")).alias(f"d{m}")
    return bootstrap(c.select("c_custkey", *[rating(m) for m in range(1, 6)]), "c_custkey", [f"d{m}" for m in range(1, 6)], 5000, 42)


def _bootstrap_sql(values: str, columns: tuple[str, ...], draws: int, seed: int) -> str:
    a, b, c = MULTIPLIERS
    x = f"(i * {a} + b * {b} + {seed}) % {MODULUS}"
    rounds = f"SELECT b, i, {x} AS x FROM v, (SELECT unnest(range({draws})) AS b)"
    for m in (a, b, c):
        rounds = f"SELECT b, i, (xor(x, x >> 15) * {m}) % {MODULUS} AS x FROM ({rounds})"
    taken = " + ".join(f"CAST(x >= {r} AS BIGINT)" for r in REACH)
    means = ", ".join(f"sum(w * {n}) / nullif(sum(CASE WHEN {n} IS NOT NULL THEN w ELSE 0 END), 0) AS {n}" for n in columns)
    rows = " UNION ALL ".join(f"SELECT '{n}' AS metric, (SELECT count({n}) FROM v) AS n, (SELECT round(avg({n}), 6) FROM v) AS mean, round(quantile_cont({n}, 0.025), 6) AS lo, round(quantile_cont({n}, 0.975), 6) AS hi FROM m" for n in columns)
    return f"WITH t AS ({values}), v AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM t), d AS (SELECT b, i, {taken} AS w FROM ({rounds})), m AS (SELECT b, {means} FROM d JOIN v ON v.i = d.i GROUP BY b) {rows}"


def _scored() -> tuple:
    return F.col("l_discount") * 10, F.col("l_returnflag") == "R"


def ece_bins(spark: SparkSession, sf: str) -> DataFrame:
    return C.bins(table(spark, sf, "lineitem"), *_scored())


def ece(spark: SparkSession, sf: str) -> DataFrame:
    return C.expected_error(table(spark, sf, "lineitem"), *_scored())


def brier_skill(spark: SparkSession, sf: str) -> DataFrame:
    return C.brier(table(spark, sf, "lineitem"), *_scored())


def clopper_pearson(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 40).alias("k"), F.count("*").alias("n"))
    return with_interval(g, "k", "n").select("l_returnflag", "k", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def logreg_calibration(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return C.logistic(li.where("l_orderkey % 4 <> 0"), li.where("l_orderkey % 4 = 0"), ["l_quantity", "l_discount"], "y", ["l_orderkey", "l_linenumber"])


def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Brier scores of five folds of lineitem, and their mean and deviation as a last row."""
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "l_quantity", "l_discount", (F.col("l_returnflag") == "R").cast("double").alias("y"))
    scores = C.cross_validated(li, ["l_quantity", "l_discount"], "y", "k")
    total = C.fold_summary(scores).select(F.lit(None).cast("int").alias("fold"), F.col("folds").alias("n"), F.col("mean").alias("brier"), "deviation")
    return scores.withColumn("deviation", F.lit(None).cast("double")).unionByName(total)


def p99(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentile of values by kind."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY value)").alias("p99"), F.round(F.avg("value"), 6).alias("mean"))


def _binary_scorings(spark: SparkSession, sf: str) -> DataFrame:
    """Four readings of answers that may abstain: abstentions as no, as yes, left out, and as a drawn answer."""
    li = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("t"), F.when(F.col("l_partkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_quantity") > 25).alias("p"), (F.col("l_orderkey") * 31 + F.col("l_partkey")).alias("k"))
    reads = {"a": F.coalesce("p", F.lit(False)), "b": F.coalesce("p", F.lit(True)), "c": F.col("p"), "d": F.coalesce(F.col("p"), F.pmod("k", F.lit(2)) == 0)}
    rows = li.select("t", F.explode(F.array(*[F.struct(F.lit(k).alias("scoring"), v.alias("p")) for k, v in reads.items()])).alias("s")).select("t", "s.scoring", "s.p")
    return rows.groupBy("scoring").agg(F.count("p").alias("n"), F.round(F.avg(F.col("p").isNotNull().cast("double")), 6).alias("coverage"), F.round(F.avg((F.col("t") == F.col("p")).cast("double")), 6).alias("accuracy"))


QUERIES = {
    "kappa_unweighted": _kappa(0),
    "kappa_linear": _kappa(1),
    "kappa_quadratic": _kappa(2),
    "icc21": (icc21, f"""WITH {_P}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(a) AS ma, avg(b) AS mb FROM p), g AS (SELECT (ma + mb) / 2 AS g FROM s),
 q AS (SELECT 2 * sum(pow((a + b) / 2 - g, 2)) AS r, sum(pow(a - g, 2) + pow(b - g, 2)) AS t FROM p, g), m AS (SELECT n, r / (n - 1) AS msr, n * (pow(ma - g, 2) + pow(mb - g, 2)) AS msc, (t - r - n * (pow(ma - g, 2) + pow(mb - g, 2))) / (n - 1) AS mse FROM q, s, g)
 SELECT CAST(n AS BIGINT) AS n, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 6) AS icc FROM m"""),
    "icc_simple": (icc_simple, f"WITH {_P}, m AS (SELECT CAST(count(*) AS BIGINT) AS n, 2 * var_samp((a + b) / 2) AS b, sum(pow(a - b, 2) / 2) / count(*) AS w FROM p) SELECT n, round((b - w) / (b + w), 6) AS icc FROM m"),
    "spearman": (spearman, f"WITH {_P}, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r"),
    "spearman_p": (spearman_p, None),
    "krippendorff": (krippendorff, "WITH v AS (SELECT l_orderkey AS u, l_quantity % 5 + 1 AS x FROM lineitem WHERE l_linenumber % 4 > 0), per AS (SELECT u, count(*) AS m, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY 1), t AS (SELECT sum(CASE WHEN m > 1 THEN 2 * m * q - 2 * s * s END) / sum(CASE WHEN m > 1 THEN m * (m - 1) END) AS o, CAST(sum(m) AS BIGINT) AS n, sum(s) AS s, sum(q) AS q FROM per) SELECT n, round(1 - o / ((2 * n * q - 2 * s * s) / (CAST(n AS DOUBLE) * (n - 1))), 6) AS alpha FROM t"),
    "exact_mae": (exact_mae, f"WITH {_P} SELECT count(*) AS n, round(avg(CAST(a = b AS INT)), 6) AS exact, round(avg(abs(a - b)), 6) AS mae, count(*) FILTER (abs(a - b) >= 2) AS far_apart FROM p"),
    "macro_f1": (macro_f1, "WITH p AS (SELECT l_returnflag AS a, CASE l_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'R' ELSE l_returnflag END AS b FROM lineitem), c AS (SELECT label, count(*) FILTER (a = label AND b = label) AS tp, count(*) FILTER (b = label) AS pr, count(*) FILTER (a = label) AS tr FROM p, (SELECT unnest(['A', 'N', 'R']) AS label) GROUP BY 1) SELECT label, tr AS support, round(CASE WHEN pr = 0 THEN 0 ELSE tp / pr END, 6) AS precision, round(CASE WHEN tr = 0 THEN 0 ELSE tp / tr END, 6) AS recall, round(CASE WHEN pr + tr = 0 THEN 0 ELSE 2.0 * tp / (pr + tr) END, 6) AS f1 FROM c"),
    "bootstrap_ci": (bootstrap_ci, _bootstrap_sql("SELECT s_suppkey AS k, CAST(s_acctbal AS DOUBLE) AS balance, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_nationkey AS DOUBLE) END AS nation FROM supplier", ("balance", "nation"), 1000, 13)),
    "bootstrap_vector": (bootstrap_vector, _bootstrap_sql("SELECT c_custkey AS k, " + ", ".join(f"CASE WHEN c_custkey % {m + 7} > 0 THEN CAST((c_custkey * {m} + c_nationkey) % 5 + 1 AS DOUBLE) END AS d{m}" for m in range(1, 6)) + " FROM customer", tuple(f"d{m}" for m in range(1, 6)), 5000, 42)),
    "ece_bins": (ece_bins, "WITH b AS (SELECT " + " + ".join(f"CAST(p >= CAST({e!r} AS DOUBLE) AS INT)" for e in C._EDGES) + " AS bin, p, y FROM (SELECT l_discount * 10 AS p, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)) SELECT CAST(r.bin AS BIGINT) AS bin, count(b.p) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y, round(abs(avg(p) - avg(y)), 6) AS gap FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON b.bin = r.bin GROUP BY 1"),
    "ece": (ece, "WITH b AS (SELECT " + " + ".join(f"CAST(p >= CAST({e!r} AS DOUBLE) AS INT)" for e in C._EDGES) + " AS bin, p, y FROM (SELECT l_discount * 10 AS p, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)), g AS (SELECT count(*) AS n, round(abs(avg(p) - avg(y)), 6) AS gap FROM b GROUP BY bin) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * gap) / sum(n), 5) AS ece FROM g"),
    "brier_skill": (brier_skill, "WITH s AS (SELECT count(*) AS n, avg(pow(l_discount * 10 - CAST(l_returnflag = 'R' AS INT), 2)) AS br, avg(CAST(l_returnflag = 'R' AS INT)) AS m FROM lineitem) SELECT n, round(br, 6) AS brier, round(m * (1 - m), 6) AS naive, round(1 - br / (m * (1 - m)), 6) AS skill FROM s"),
    "clopper_pearson": (clopper_pearson, "WITH RECURSIVE g AS (SELECT l_returnflag, count(*) FILTER (l_quantity > 40) AS k, count(*) AS n FROM lineitem GROUP BY 1)," + exact_interval("g", "l_returnflag") + " SELECT l_returnflag, k, n, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci"),
    "logreg_calibration": (logreg_calibration, None),
    "fold_scores": (fold_scores, None),
    "p99": (p99, "SELECT event_type, quantile_disc(value, 0.99) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "binary_scorings": (_binary_scorings, "WITH l AS (SELECT l_returnflag = 'R' AS t, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity > 25 END AS p, l_orderkey * 31 + l_partkey AS k FROM lineitem), s AS (SELECT 'a' AS scoring, t, coalesce(p, false) AS p FROM l UNION ALL SELECT 'b', t, coalesce(p, true) FROM l UNION ALL SELECT 'c', t, p FROM l UNION ALL SELECT 'd', t, coalesce(p, k % 2 = 0) FROM l) SELECT scoring, count(p) AS n, round(avg(CAST(p IS NOT NULL AS INT)), 6) AS coverage, round(avg(CAST(t = p AS INT)), 6) AS accuracy FROM s GROUP BY 1"),
}
