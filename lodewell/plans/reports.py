"""Relational queries: joins, aggregations, windows, sets and report tables over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports as P
from .base import table

_DECISIONS = ("likely_match", "unlikely_match", "possible_match", "cannot_determine")


def _judged_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Answers by two made-up raters: decisions, flags and tags by arithmetic on the keys."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    r = c.withColumn("rater", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("k", F.col("conv_id") + F.col("turn") + F.when(F.col("rater") == "b", F.col("conv_id") % 3).otherwise(0))
    decision = F.element_at(F.array(*[F.lit(d) for d in _DECISIONS]), (F.col("k") % 4 + 1).cast("int"))
    return r.select("conv_id", "turn", "rater", (F.col("conv_id") % 3).alias("model"), decision.alias("decision"), (F.col("k") % 5 == 0).cast("int").alias("leak"), F.concat_ws(",", F.when(F.col("k") % 2 == 0, " Vague "), F.when(F.col("k") % 3 == 0, "wrong"), F.when(F.col("k") % 7 == 0, "")).alias("tags"), (F.col("k") % 5 + 1).cast("double").alias("score"))


_JT = """jt AS (SELECT conv_id, turn, rater, conv_id % 3 AS model, ['likely_match','unlikely_match','possible_match','cannot_determine'][CAST(k % 4 + 1 AS INT)] AS decision, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS leak,
 concat_ws(',', CASE WHEN k % 2 = 0 THEN ' Vague ' END, CASE WHEN k % 3 = 0 THEN 'wrong' END, CASE WHEN k % 7 = 0 THEN '' END) AS tags, CAST(k % 5 + 1 AS DOUBLE) AS score
 FROM (SELECT conv_id, turn, rater, conv_id + turn + CASE WHEN rater = 'b' THEN conv_id % 3 ELSE 0 END AS k FROM conversations CROSS JOIN (SELECT unnest(['a', 'b']) AS rater) WHERE role = 'assistant'))"""


def _rate_report(kind: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        s = P.DECISION_SETS[kind]
        return P.rates(_judged_turns(spark, sf), ["model"], {"leak_rate": F.col("leak") > 0, "commit_rate": F.col("decision").isin(*s["commit"]), "abstain_rate": F.col("decision").isin(*s["abstain"])})

    names = P.DECISION_SETS[kind]
    inside = lambda xs: "decision IN (" + ", ".join(f"'{x}'" for x in xs) + ")"
    sql = f"WITH {_JT} SELECT model, count(*) AS n, round(avg(CAST(leak > 0 AS INT)), 6) AS leak_rate, round(avg(CAST({inside(names['commit'])} AS INT)), 6) AS commit_rate, round(avg(CAST({inside(names['abstain'])} AS INT)), 6) AS abstain_rate FROM jt GROUP BY 1"
    return q, sql


def grouping_sets_report(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    g = P.grouping_sets(o, [["o_orderstatus"], ["o_orderpriority", "o_orderstatus"], []], {"orders": F.count("*"), "customers": F.countDistinct("o_custkey"), "total": F.round(F.sum("o_totalprice"), 2)})
    return g.select("o_orderstatus", "o_orderpriority", "orders", "customers", F.round("total", 0).alias("total"))


def cube_rollup(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def two_level_mean(spark: SparkSession, sf: str) -> DataFrame:
    return P.mean_of_means(_judged_turns(spark, sf), ["model"], ["conv_id", "turn"], ["score"])


def tag_share(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.transform(T.cell_list(F.col("tags")), F.lower)
    return P.tag_shares(_judged_turns(spark, sf), ["model"], tags, "conv_id", "rater")


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.filter(F.transform(T.cell_list(F.col("tags")), F.lower), lambda x: x != "")
    rows = _judged_turns(spark, sf).select(F.explode(F.when(F.size(t) == 0, F.array(F.lit("none"))).otherwise(t)).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


def pivot_flags(spark: SparkSession, sf: str) -> DataFrame:
    return P.rater_flags(_judged_turns(spark, sf), ["conv_id", "turn"], "rater", "leak", ["a", "b"]).select("conv_id", "turn", "a", "b", "any_flag", "all_flag", F.col("n_raters").cast("long").alias("n_raters"))


def stratum_rates(spark: SparkSession, sf: str) -> DataFrame:
    f = P.rater_flags(_judged_turns(spark, sf), ["conv_id", "turn", "model"], "rater", "leak", ["a", "b"])
    long = P.melt(f.withColumn("stratum", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")), ["stratum", "model"], ["any_flag", "all_flag"], "detector", "flag")
    return long.groupBy("stratum", "model", "detector").agg(F.count("flag").alias("n"), F.round(F.avg("flag"), 6).alias("rate"))


def melt_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    short = p.withColumn("overall", F.round(P.row_mean("size", "price"), 4))
    return P.melt(short, ["p_partkey"], ["size", "price", "overall"])


def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return P.confusion(li, F.col("l_returnflag") == "R", F.col("l_quantity") > 25, ["l_linestatus"])


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged_turns(spark, sf)
    a, b = j.where("rater = 'a'").select("conv_id", "turn", F.col("decision").alias("t")), j.where("rater = 'b'").select("conv_id", "turn", F.col("decision").alias("p"))
    return a.join(b, ["conv_id", "turn"]).groupBy("t", "p").agg(F.count("*").alias("n"))


def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return P.keep_one(table(spark, sf, "events"), ["user_id", "event_type"], F.asc("ts"), F.asc("event_id")).select("user_id", "event_type", "event_id")


def dedupe_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return P.keep_one(table(spark, sf, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events")
    return e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase'").select("user_id")


def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)
    return a.intersect(b)


def set_except(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)
    return a.subtract(b)


def set_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)
    return a.union(b).distinct()


def union_all(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy(F.col("balance").isNull().alias("no_balance")).agg(F.count("*").alias("n"), F.count("nation").alias("nations"))


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus"), 256).alias("digest"))
    left = o.where("o_orderkey % 3 <> 0")
    right = o.where("o_orderkey % 3 <> 1").withColumn("digest", F.when(F.col("o_orderkey") % 5 == 0, F.lit("changed")).otherwise(F.col("digest")))
    return P.aligned(left, right, "o_orderkey", "digest").groupBy("state").agg(F.count("*").alias("n"))


def left_join_fill(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("big", F.lit(True))
    return c.join(big, "c_custkey", "left").groupBy("c_mktsegment", F.coalesce("big", F.lit(False)).alias("big")).agg(F.count("*").alias("n"))


def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    late = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(late, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


def chain_join(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.groupBy("r_name").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


def self_join_delta(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    base = s.where("l_linestatus = 'O'").select("l_returnflag", F.col("n").alias("n0"))
    return s.join(base, "l_returnflag").select("l_returnflag", "l_linestatus", (F.col("n") - F.col("n0")).alias("delta"))


def cross_join_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every region under every setting of two written-out lists."""
    r = table(spark, sf, "region").select("r_regionkey")
    return r.withColumn("level", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("mode", F.explode(F.array(F.lit("a"), F.lit("b"))))


def running_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = table(spark, sf, "orders")
    return o.select("o_custkey", "o_orderkey", F.count("*").over(w).alias("so_far"), F.max("o_totalprice").over(w).alias("most"))


def window_shares(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.round(F.col("c_acctbal") - F.min("c_acctbal").over(w), 2).alias("above_least"), F.row_number().over(w.orderBy(F.desc("c_acctbal"), F.asc("c_custkey"))).cast("long").alias("place"), F.count("*").over(w).alias("n"))


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return s.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def concat_group(spark: SparkSession, sf: str) -> DataFrame:
    """Text of a group in a stated order."""
    n = table(spark, sf, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), " ").alias("names"))


def column_means(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    numeric = [n for n, t in p.dtypes if t in ("int", "double", "bigint") and not n.endswith("key")]
    return p.agg(*[F.round(F.avg(c), 4).alias(c) for c in numeric])


def pivot_table(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    p = li.groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_quantity"), 6)).na.fill(0.0)
    return p.select(F.col("l_linenumber").cast("long").alias("l_linenumber"), "A", "N", "R")


def recode_numbers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    o = o.withColumn("status", T.recode(F.col("o_orderstatus"), {"F": 1, "O": 2})).withColumn("urgency", T.number(F.substring_index("o_orderpriority", "-", 1)))
    return o.groupBy("status", "urgency").agg(F.count("*").alias("n"))


def audit_counters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    low = F.lower(F.trim("event_type"))
    return e.agg(F.count_if(low.isin("click", "view")).alias("seen"), F.count_if(low == "purchase").alias("bought"), F.round(100 * T.ratio(F.count_if(low == "error"), F.count("*")), 4).alias("error_pct"))


def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(table(spark, sf, "lineitem"), F.col("l_quantity"), 0.0, 2.0, 26)


def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.orderBy(P.by_list(F.col("o_orderstatus"), ["P", "F", "O"]), F.desc("o_totalprice"), F.asc("o_orderkey")).limit(25).select("o_orderkey", "o_orderstatus")


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("k", F.from_json("props", "k INT")["k"])
    return e.groupBy("event_type").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.sum("k").alias("total"))


def text_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets, truncations, tags and blind ids of documents."""
    d = table(spark, sf, "documents")
    c = F.col("text")
    return d.select("doc_id", F.md5(T.shorten(c, 200).cast("binary")).alias("short"), F.md5(T.snippet(c, 160).cast("binary")).alias("snip"), T.blind_id(10, F.lit("salt"), F.col("doc_id")).alias("blind"), T.safe_tag(F.concat(F.col("source"), F.lit("/x-y"))).alias("tag"), F.format_string("case_%03d", F.col("doc_id")).alias("name"), F.size(T.stripped_words(c)).cast("long").alias("words"))


QUERIES = {
    "rate_report": _rate_report("strict"),
    "rate_report_lenient": _rate_report("lenient"),
    "grouping_sets_report": (grouping_sets_report, "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority, o_orderstatus), ())"),
    "cube_rollup": (cube_rollup, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "two_level_mean": (two_level_mean, f"WITH {_JT}, c AS (SELECT model, conv_id, turn, avg(score) AS score FROM jt GROUP BY 1, 2, 3) SELECT model, count(*) AS cases, round(avg(score), 6) AS score FROM c GROUP BY 1"),
    "tag_share": (tag_share, f"WITH {_JT}, t AS (SELECT model, lower(trim(unnest(string_split(tags, ',')))) AS tag FROM jt), b AS (SELECT model, count(DISTINCT conv_id) * count(DISTINCT rater) AS al FROM jt GROUP BY 1) SELECT t.model, t.tag, count(*) AS n, round(count(*) / any_value(b.al), 6) AS share FROM t JOIN b USING (model) WHERE tag <> '' GROUP BY 1, 2"),
    "tag_counts": (tag_counts, f"WITH {_JT}, t AS (SELECT list_filter(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS t FROM jt), u AS (SELECT unnest(CASE WHEN len(t) = 0 THEN ['none'] ELSE t END) AS tag FROM t) SELECT tag, count(*) AS n FROM u GROUP BY 1"),
    "pivot_flags": (pivot_flags, f"WITH {_JT}, w AS (SELECT conv_id, turn, max(CASE WHEN rater = 'a' THEN leak END) AS a, max(CASE WHEN rater = 'b' THEN leak END) AS b FROM jt GROUP BY 1, 2) SELECT conv_id, turn, a, b, greatest(a, b) AS any_flag, least(a, b) AS all_flag, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS BIGINT) AS n_raters FROM w"),
    "stratum_rates": (stratum_rates, f"WITH {_JT}, w AS (SELECT conv_id, turn, model, max(CASE WHEN rater = 'a' THEN leak END) AS a, max(CASE WHEN rater = 'b' THEN leak END) AS b FROM jt GROUP BY 1, 2, 3), l AS (SELECT conv_id, model, 'any_flag' AS detector, greatest(a, b) AS flag FROM w UNION ALL SELECT conv_id, model, 'all_flag', least(a, b) FROM w) SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS stratum, model, detector, count(flag) AS n, round(avg(flag), 6) AS rate FROM l GROUP BY 1, 2, 3"),
    "melt_metrics": (melt_metrics, "SELECT p_partkey, 'size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part UNION ALL SELECT p_partkey, 'overall', round((p_size + p_retailprice) / 2, 4) FROM part"),
    "confusion_counts": (confusion_counts, "WITH c AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS tp, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25) AS fp, count(*) FILTER (l_returnflag = 'R' AND NOT l_quantity > 25) AS fn, count(*) FILTER (l_returnflag <> 'R' AND NOT l_quantity > 25) AS tn FROM lineitem GROUP BY 1) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"),
    "confusion_matrix": (confusion_matrix, f"WITH {_JT} SELECT a.decision AS t, b.decision AS p, count(*) AS n FROM jt a JOIN jt b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.rater = 'a' AND b.rater = 'b' GROUP BY 1, 2"),
    "dedupe_keep_first": (dedupe_keep_first, "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1"),
    "dedupe_keep_last": (dedupe_keep_last, "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "set_intersect": (set_intersect, "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'"),
    "set_except": (set_except, "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'"),
    "set_union": (set_union, "SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase'"),
    "union_all": (union_all, "SELECT balance IS NULL AS no_balance, count(*) AS n, count(nation) AS nations FROM (SELECT c_acctbal AS balance, NULL::INT AS nation FROM customer UNION ALL SELECT NULL, s_nationkey FROM supplier) GROUP BY 1"),
    "manifest_diff": (manifest_diff, "WITH o AS (SELECT o_orderkey AS k, sha256(CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus) AS d FROM orders), l AS (SELECT * FROM o WHERE k % 3 <> 0), r AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'changed' ELSE d END AS d FROM o WHERE k % 3 <> 1) SELECT CASE WHEN r.d IS NULL THEN 'only_left' WHEN l.d IS NULL THEN 'only_right' WHEN l.d = r.d THEN 'same' ELSE 'different' END AS state, count(*) AS n FROM l FULL JOIN r ON l.k = r.k GROUP BY 1"),
    "left_join_fill": (left_join_fill, "SELECT c_mktsegment, coalesce(b.big, false) AS big, count(*) AS n FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey, true AS big FROM orders WHERE o_totalprice > 300000) b ON b.o_custkey = c.c_custkey GROUP BY 1, 2"),
    "semi_join": (semi_join, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1"),
    "anti_join": (anti_join, "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "chain_join": (chain_join, "SELECT r_name, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "self_join_delta": (self_join_delta, "WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT s.l_returnflag, s.l_linestatus, s.n - b.n AS delta FROM s JOIN s b ON b.l_returnflag = s.l_returnflag AND b.l_linestatus = 'O'"),
    "cross_join_grid": (cross_join_grid, "SELECT r_regionkey, level, mode FROM region, (SELECT unnest([1, 2, 3]) AS level), (SELECT unnest(['a', 'b']) AS mode)"),
    "running_sum": (running_sum, "SELECT o_custkey, o_orderkey, count(*) OVER w AS so_far, max(o_totalprice) OVER w AS most FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"),
    "window_shares": (window_shares, "SELECT c_custkey, round(c_acctbal - min(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS above_least, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer"),
    "value_counts": (value_counts, "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2"),
    "group_sizes": (group_sizes, "SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)"),
    "concat_group": (concat_group, "SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1"),
    "column_means": (column_means, "SELECT round(avg(p_size), 4) AS p_size, round(avg(p_retailprice), 4) AS p_retailprice FROM part"),
    "pivot_table": (pivot_table, "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, " + ", ".join(f"coalesce(round(avg(CASE WHEN l_returnflag = '{f}' THEN l_quantity END), 6), 0) AS \"{f}\"" for f in "ANR") + " FROM lineitem GROUP BY 1"),
    "recode_numbers": (recode_numbers, "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status, coalesce(TRY_CAST(string_split(o_orderpriority, '-')[1] AS DOUBLE), 0.0) AS urgency, count(*) AS n FROM orders GROUP BY 1, 2"),
    "audit_counters": (audit_counters, "SELECT count(*) FILTER (event_type IN ('click', 'view')) AS seen, count(*) FILTER (event_type = 'purchase') AS bought, round(100 * (count(*) FILTER (event_type = 'error') / count(*)), 4) AS error_pct FROM events"),
    "value_histogram": (value_histogram, "SELECT CAST(least(25, greatest(0, floor(l_quantity / 2.0))) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1"),
    "top_orders": (top_orders, "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 4 END, o_totalprice DESC, o_orderkey LIMIT 25"),
    "json_props": (json_props, "SELECT event_type, min(k) AS least, max(k) AS most, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1"),
    "text_shapes": (text_shapes, r"""SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '...' END) AS short, md5(replace(substr(text, 1, 160), chr(10), ' ')) AS snip, substr(sha1('salt:' || doc_id), 1, 10) AS blind,
 replace(replace(source || '/x-y', '/', '__'), '-', '_') AS tag, 'case_' || CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 3 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 3, '0') END AS name,
 len(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: regexp_replace(w, '^[.,;:()]+|[.,;:()]+$', '', 'g')), lambda w: regexp_full_match(w, '\p{L}{6,}')))) AS words FROM documents"""),
}
