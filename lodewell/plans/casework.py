"""Queries of two-stage passage search, baselines, strata, abstention, leaks over all documents, and case records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import batch_scorer
from ..operators import agreement as A, evidence as E, guard as G, reports as P, retrieval as R, sweep
from .base import BM25, exact_interval, table, topics
from .evidence import _CASES, _CHUNKS, _ROWS, _SIGNALS, _SWEEP, _cases, _passages, _rows, _sweep
from .guards import _ANS, _NARROW, _WORDS, _answers
from .retrieval import QUERIES as _RETRIEVAL


def passage_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Topics' best eight passages, out of those of their twenty best documents."""
    run = R.bm25(table(spark, sf, "documents"), topics(spark, sf), 20)
    out = R.passage_search(run, _passages(spark, sf), topics(spark, sf))
    return out.select("query_id", "doc_id", "passage_id", "score", F.col("rank").cast("long").alias("rank"))


def rerank_concatenated(spark: SparkSession, sf: str) -> DataFrame:
    run = R.bm25(table(spark, sf, "documents"), topics(spark, sf), 50)
    out = R.reranked(run, topics(spark, sf), R.concatenated(_passages(spark, sf)), k=10)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two settings of one index by the number of documents found and their mean best score."""
    found = {}
    ix = R.index(table(spark, sf, "documents"), topics(spark, sf))
    for name, b in (("length 0.75", 0.75), ("length 0.4", 0.4)):
        found[name] = R.search(ix, 10, b=b).agg(F.count("*").cast("double").alias("found"), F.avg("score").alias("score"))
    return R.compared(found, ["found", "score"])


def evidence_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's passages as one text of headed blocks."""
    p = _passages(spark, sf)
    block = T.evidence_block(F.col("i") + 1, F.col("doc_id"), F.col("section"), F.col("passage_text"))
    rows = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))).alias("b"))
    return rows.select("doc_id", F.size("b").cast("long").alias("n"), F.md5(F.array_join(F.transform("b", lambda x: x["b"]), "\n\n").cast("binary")).alias("digest"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "part", "doc_id", "cross")))


def _shared_terms(queries, texts):
    """The share of each query's distinct terms that its text has; stands for a model."""
    words = [(set(re.findall("[a-z0-9]+", q.lower())), set(re.findall("[a-z0-9]+", t.lower()))) for q, t in zip(queries, texts, strict=True)]
    return [len(q & t) / len(q) if q else 0.0 for q, t in words]


def rerank_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Reranking by a model that takes batches."""
    run = R.bm25(table(spark, sf, "documents"), topics(spark, sf), 50)
    out = R.reranked(run, topics(spark, sf), table(spark, sf, "documents"), batch_scorer(lambda: _shared_terms), k=10)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def highest_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The highest rate of late answers over groups."""
    rates = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"))
    return rates.agg(F.round(F.max("rate"), 6).alias("rate"))


def default_config(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep's row of the default setting beside that of the best."""
    s = _sweep(spark, sf)
    best = sweep.best_row(s, F.desc("f1"), F.asc("config")).select(F.lit("best").alias("which"), "config", "f1")
    return best.unionByName(s.where("rho = 1.35 AND tau = 0.28 AND mu = 0.0 AND kappa = 2").select(F.lit("default").alias("which"), "config", "f1"))


def three_raters(spark: SparkSession, sf: str) -> DataFrame:
    """Three raters' scores by arithmetic, joined on the case; how often all three agree."""
    o = table(spark, sf, "orders")
    rater = lambda k, n: o.where(F.col("o_orderkey") % n != 0).select("o_orderkey", (F.col("o_orderkey") % k % 3).alias(f"r{k}"))
    j = rater(5, 7).join(rater(4, 11), "o_orderkey").join(rater(3, 13), "o_orderkey")
    return j.agg(F.count("*").alias("n"), F.count_if((F.col("r5") == F.col("r4")) & (F.col("r4") == F.col("r3"))).alias("agree"))


def map_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON map of any keys as rows."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string, string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


def baseline_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbered(spark, sf)
    both = [E.baseline_evidence(rows, 3, one).select(F.lit(name).alias("baseline"), "query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"), "reference") for name, one in (("all groups", False), ("first group", True))]
    return both[0].unionByName(both[1])


def strata_tags(spark: SparkSession, sf: str) -> DataFrame:
    s = E.strata(_cases(spark, sf))
    return s.groupBy("is_adversarial", "is_deployed_accept").agg(F.count("*").alias("cases"), F.sum(F.col("relevant").cast("long")).alias("relevant"))


def abstention_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Gold is a supplier class by arithmetic; the pool is what the case's rows name."""
    d = E.decision(_cases(spark, sf), E.gates(1.35, 0.28, 1.0, 2, generic="generic")).withColumn("gold", F.col("query_id") % 3)
    flagged = d.withColumn("flag", F.col("query_id") % 5 == 0)
    return E.abstention_cost(flagged, _rows(spark, sf), flag="flag")


def newly_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Cases that only the gate on dominance kept out."""
    c = _cases(spark, sf)
    masks = E.gates(1.35, 0.28, 1.0, 2, generic="generic")
    return c.where(E.all_of(masks, "rho") & ~masks["rho"]).select("query_id", "selected", F.round("dominance", 3).alias("dominance"))


def leak_all(spark: SparkSession, sf: str) -> DataFrame:
    """Answers against the distinctive words of all documents; an answer holds another document's every fifth time."""
    a = _answers(spark, sf)
    swap = F.pmod(F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0), F.lit(1 << 40))
    told = a.select(swap.alias("doc_id"), "own", "answer", F.col("doc_id").alias("case"))
    flags = G.leak_flags(told.select("case", "answer", F.col("doc_id").alias("own"), F.col("own").alias("name")), G.distinctive_terms(table(spark, sf, "documents")), "case", G.narrow_leaks(F.col("answer"), F.col("name"), r"(?i)DOC\d{8}"))
    return flags.select("case", "narrow", "wide")


def leak_intervals(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf).select("source", (G.narrow_leaks(F.col("answer"), F.col("own"), r"(?i)DOC\d{8}") > 0).alias("narrow"))
    return G.leak_summary(a, ["source"], ["narrow"])


def judge_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Two judges by arithmetic over orders; their consensus, and the label of what both call a leak."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 3 == 0).cast("int").alias("a"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 2 == 0).cast("int")).alias("b"), F.concat(F.lit(" t"), F.col("o_orderkey") % 7).alias("label"))
    c = o.withColumn("c", G.consensus(F.col("a"), F.col("b")))
    label = G.taxonomy(F.col("label"), F.col("c.both"), ["T1", "T2", "T3", "T4"])
    return c.groupBy(F.col("c.either").alias("either"), F.col("c.both").alias("both"), F.col("c.agree").alias("agree"), label.alias("label")).agg(F.count("*").alias("n"))


def abstention_records(spark: SparkSession, sf: str) -> DataFrame:
    d = E.decision(_cases(spark, sf), E.gates(1.35, 0.28, 1.0, 2, generic="generic")).where("NOT accepted")
    r = d.select(G.abstention_record(F.col("query_id"), F.col("failed_gate"), "Not stated.", ["answer", "summary"]).alias("r"))
    return r.select("r.case_id", "r.status", "r.reason", "r.answer", "r.summary", F.size("r.supports").cast("long").alias("n_supports"))


def redaction_audit(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return G.redaction_audit(li, F.col("l_discount") > 0.05, "l_returnflag")


def variant_records(spark: SparkSession, sf: str) -> DataFrame:
    record = lambda c, ok: F.when(ok, F.struct(F.col(c).alias("answer")))
    p = table(spark, sf, "part").select("p_partkey", F.struct(record("p_type", F.col("p_size") % 2 == 0).alias("strict"), record("p_name", F.lit(True)).alias("plain")).alias("bundle"))
    return p.select("p_partkey", F.explode(G.uniform(F.col("bundle"), ["strict", "plain"], "answer")).alias("u")).select("p_partkey", "u.variant", F.col("u.value").alias("answer"))


def undefined_metrics(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return P.undefined_reasons(li, {"per_discount": (F.try_divide("l_tax", "l_discount"), "no discount"), "per_tax": (F.try_divide("l_discount", "l_tax"), "no tax")})


def column_mask(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("x"), F.substring("o_orderpriority", 1, 1).alias("y"), (F.col("o_orderkey") % 3).cast("string").alias("z"))
    return o.where(P.any_of(["x", "y", "z"], "1")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def run_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first three rows of a run without and with a rank column."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("score"))
    a = s.orderBy(*P.by_rank_or_score(s), "s_suppkey").limit(3).select(F.lit("score").alias("by"), "s_suppkey")
    ranked = s.withColumn("rank", F.col("s_suppkey"))
    return a.union(ranked.orderBy(*P.by_rank_or_score(ranked), "s_suppkey").limit(3).select(F.lit("rank"), "s_suppkey"))


def rounded_halves(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select((F.col("l_linenumber") / 2).alias("x"))
    return li.groupBy(T.half_even(F.col("x")).cast("long").alias("rounded")).agg(F.count("*").alias("n"))


def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where(T.starts_with_any(F.col("p_type"), ["STANDARD", "SMALL"]))
    return p.groupBy("p_type").agg(F.count("*").alias("n"))


def short_lists(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    return n.select("n_regionkey", F.array_join(T.distinct_heads(F.col("names"), 1, 2), "|").alias("names"))


def rubric_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    """Two rubric fields by arithmetic, one of them inverted, as the dimension that they give."""
    word = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("Yes", " partial", "no", "maybe", "?")]), (F.col("c_custkey") % k % 5 + 1).cast("int"))
    sheet = table(spark, sf, "customer").select("c_custkey", word(5).alias("needs_domain_expert_review"), word(7).alias("overall_usable"))
    return sheet.select("c_custkey", A.judged_dimensions(sheet)["safety"].alias("safety"))


_LEVEL = "CASE {c} % {k} % 5 WHEN 0 THEN {a} WHEN 1 THEN 3 WHEN 2 THEN {b} WHEN 3 THEN 3 END"
_TOP = "top AS (SELECT query_id, doc_id, score AS doc_score FROM bm WHERE rank <= {k})"
_RERANK = _RETRIEVAL["rerank_topk"][1]
_TERMS = "list_distinct(regexp_extract_all(lower(t.text), '[a-z0-9]+'))"
_COMPARED = " UNION ALL ".join("(WITH " + BM25.replace("(1 - 0.75 + 0.75 *", f"(1 - {b} + {b} *") + f" SELECT 'length {b}' AS method, CAST(count(*) AS DOUBLE) AS found, round(avg(score), 4) AS score FROM bm WHERE rank <= 10)" for b in (0.75, 0.4))
_PICKED = _ROWS + ", f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY query_id ORDER BY rank) AS reference FROM rows)"
_STATUS = _CASES + ", dec AS (SELECT *, CASE WHEN NOT dominance >= 1.35 THEN 'rho' WHEN NOT share >= 0.28 THEN 'tau' WHEN NOT raw_max >= 1.0 THEN 'mu' WHEN NOT best_rank <= 2 THEN 'kappa' WHEN generic THEN 'generic' ELSE 'none' END AS f FROM cas)"

QUERIES = {
    "passage_topk": (passage_topk, "WITH RECURSIVE " + BM25 + ", " + _CHUNKS + ", " + _TOP.format(k=20) + f""",
s AS (SELECT top.query_id, chunks.doc_id, passage_id, doc_score, round(len(list_intersect({_TERMS}, regexp_extract_all(lower(passage_text), '[a-z0-9]+'))) / len({_TERMS}), 6) AS score
  FROM chunks JOIN top USING (doc_id) JOIN topics t ON t.query_id = top.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_score DESC, passage_id) AS rank FROM s)
SELECT query_id, doc_id, passage_id, score, rank FROM r WHERE rank <= 8"""),
    "rerank_concatenated": (rerank_concatenated, "WITH " + BM25 + ", " + _CHUNKS + f""",
cat AS (SELECT doc_id, string_agg(passage_text, ' ' ORDER BY i) AS text FROM chunks GROUP BY 1),
s AS (SELECT bm.query_id, bm.doc_id, bm.rank AS fr, round(len(list_intersect({_TERMS}, regexp_extract_all(lower(coalesce(cat.text, '')), '[a-z0-9]+'))) / len({_TERMS}), 6) AS score
  FROM bm JOIN topics t USING (query_id) LEFT JOIN cat ON cat.doc_id = bm.doc_id WHERE bm.rank <= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10"""),
    "method_comparison": (method_comparison, _COMPARED),
    "rerank_by_model": (rerank_by_model, _RERANK),
    "highest_rate": (highest_rate, "SELECT round(max(r), 6) AS rate FROM (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS r FROM orders GROUP BY o_orderpriority)"),
    "default_config": (default_config, "WITH " + _SWEEP + " (SELECT 'best' AS which, config, f1 FROM sw ORDER BY f1 DESC, config LIMIT 1) UNION ALL SELECT 'default', config, f1 FROM sw WHERE rho = 1.35 AND tau = 0.28 AND mu = 0 AND kappa = 2"),
    "three_raters": (three_raters, "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 % 3 = o_orderkey % 4 % 3 AND o_orderkey % 4 % 3 = o_orderkey % 3 % 3) AS agree FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0"),
    "map_entries": (map_entries, "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events"),
    "evidence_blocks": (evidence_blocks, "WITH " + _CHUNKS + " SELECT doc_id, count(*) AS n, md5(string_agg('[Passage ' || (i + 1) || ' | doc=' || doc_id || ' | section=text]' || chr(10) || passage_text, chr(10) || chr(10) ORDER BY i)) AS digest FROM chunks GROUP BY 1"),
    "baseline_evidence": (baseline_evidence, "WITH " + _PICKED + """,
b AS (SELECT 'all groups' AS baseline, query_id, doc_id, rank, reference FROM f UNION ALL SELECT 'first group', query_id, doc_id, rank, reference FROM f WHERE doc_id = reference),
n AS (SELECT *, row_number() OVER (PARTITION BY baseline, query_id ORDER BY rank) AS position FROM b) SELECT baseline, query_id, doc_id, rank, position, reference FROM n WHERE position <= 3"""),
    "strata_tags": (strata_tags, "WITH " + _SIGNALS + ", c AS (SELECT round(dominance, 3) AS d, n_groups, query_id % 3 = selected AS relevant FROM sig) SELECT CAST(d < 1.5 AND n_groups >= 2 AS INT) AS is_adversarial, CAST(d >= 1.35 AND n_groups >= 2 AS INT) AS is_deployed_accept, count(*) AS cases, CAST(sum(CAST(relevant AS INT)) AS BIGINT) AS relevant FROM c GROUP BY 1, 2"),
    "abstention_cost": (abstention_cost, "WITH " + _STATUS + ", p AS (SELECT DISTINCT query_id, doc_id FROM rows), a AS (SELECT CASE WHEN f = 'none' THEN 'accepted' ELSE 'abstained' END AS status, dec.query_id % 5 = 0 OR p.doc_id IS NOT NULL AS ok FROM dec LEFT JOIN p ON p.query_id = dec.query_id AND p.doc_id = dec.query_id % 3) SELECT status, count(*) AS n, count(*) FILTER (ok) AS available, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM a GROUP BY 1"),
    "newly_accepted": (newly_accepted, "WITH " + _CASES + " SELECT query_id, selected, dominance FROM cas WHERE NOT dominance >= 1.35 AND share >= 0.28 AND raw_max >= 1.0 AND best_rank <= 2 AND NOT generic"),
    "leak_all": (leak_all, f"""WITH {_ANS}, {_WORDS},
q AS (SELECT doc_id AS c, CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END AS mine, {_NARROW} > 0 AS narrow, list_distinct(string_split_regex(lower(answer), '\\s+')) AS ws FROM a),
k AS (SELECT c, mine, unnest(ws) AS word FROM q), d AS (SELECT DISTINCT word FROM k WHERE length(word) >= 6),
i AS (SELECT word, unnest(range(1, length(word) - 4)) AS i FROM d), sub AS (SELECT DISTINCT word, substr(word, i, n) AS part FROM (SELECT word, i, unnest(range(6, length(word) - i + 2)) AS n FROM i)),
h AS (SELECT sub.word, o.doc_id FROM sub JOIN o ON o.w = sub.part),
x AS (SELECT DISTINCT c FROM k JOIN h ON h.word = k.word AND h.doc_id <> mine)
SELECT q.c AS "case", narrow, narrow OR x.c IS NOT NULL AS wide FROM q LEFT JOIN x ON x.c = q.c"""),
    "leak_intervals": (leak_intervals, f"WITH RECURSIVE {_ANS}, g AS (SELECT source, count(*) FILTER ({_NARROW} > 0) AS k, count(*) AS n FROM a GROUP BY 1)," + exact_interval("g", "source") + " SELECT source, n, round(k / n, 4) AS narrow_rate, round(lo, 4) AS narrow_lo, round(hi, 4) AS narrow_hi FROM ci"),
    "judge_consensus": (judge_consensus, """WITH o AS (SELECT CAST(o_orderkey % 3 = 0 AS INT) AS a, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 2 = 0 AS INT) END AS b, 'T' || (o_orderkey % 7) AS l FROM orders),
c AS (SELECT greatest(a, b) AS either, CASE WHEN b IS NULL THEN a ELSE least(a, b) END AS "both", CAST(a = b AS INT) AS agree, l FROM o)
SELECT either, "both", agree, CASE WHEN "both" = 0 THEN 'none' WHEN l IN ('T1', 'T2', 'T3', 'T4') THEN l ELSE 'T1' END AS label, count(*) AS n FROM c GROUP BY 1, 2, 3, 4"""),
    "abstention_records": (abstention_records, "WITH " + _STATUS + " SELECT query_id AS case_id, 'abstained' AS status, f AS reason, 'Not stated.' AS answer, 'Not stated.' AS summary, CAST(0 AS BIGINT) AS n_supports FROM dec WHERE f <> 'none'"),
    "redaction_audit": (redaction_audit, "SELECT l_returnflag, count(*) AS claims, count(*) FILTER (l_discount > 0.05) AS dropped, round(count(*) FILTER (l_discount > 0.05) / count(*), 6) AS rate FROM lineitem GROUP BY 1"),
    "variant_records": (variant_records, "SELECT p_partkey, 'strict' AS variant, p_type AS answer FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'plain', p_name FROM part"),
    "undefined_metrics": (undefined_metrics, "SELECT 'per_discount' AS metric, count(*) AS n, count(*) FILTER (l_discount = 0) AS undefined, 'no discount' AS reason FROM lineitem UNION ALL SELECT 'per_tax', count(*), count(*) FILTER (l_tax = 0), 'no tax' FROM lineitem"),
    "column_mask": (column_mask, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus = '1' OR o_orderpriority LIKE '1%' OR o_orderkey % 3 = 1"),
    "run_order": (run_order, "(SELECT 'score' AS by, s_suppkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey LIMIT 3) UNION ALL (SELECT 'rank', s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 3)"),
    "rounded_halves": (rounded_halves, "SELECT CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber // 2 WHEN (l_linenumber // 2) % 2 = 0 THEN l_linenumber // 2 ELSE l_linenumber // 2 + 1 END AS BIGINT) AS rounded, count(*) AS n FROM lineitem GROUP BY 1"),
    "prefix_filter": (prefix_filter, "SELECT p_type, count(*) AS n FROM part WHERE starts_with(p_type, 'STANDARD') OR starts_with(p_type, 'SMALL') GROUP BY 1"),
    "rubric_crosswalk": (rubric_crosswalk, "WITH l AS (SELECT c_custkey, " + _LEVEL.format(c="c_custkey", k=5, a=1, b=5) + " AS x, " + _LEVEL.format(c="c_custkey", k=7, a=5, b=1) + " AS y FROM customer) SELECT c_custkey, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE (x + y) / 2 END AS safety FROM (SELECT c_custkey, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM l)"),
    "short_lists": (short_lists, "WITH f AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey, substr(n_name, 1, 1) ORDER BY n_nationkey) AS h FROM nation), k AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM f WHERE h = 1) SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM k WHERE r <= 2 GROUP BY 1"),
}
