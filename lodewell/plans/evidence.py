"""Queries of corpus building, evidence, gates and sweeps.

Cases are orders, their passages lineitems: rank is the line number, the raw score
falls with the discount, the group is the supplier's number modulo 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import generic_flag, sentences
from ..operators import corpus, evidence as E, sweep
from .base import table


def corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    d = corpus.with_columns_present(table(spark, sf, "documents"), ["text", "source", "title"])
    text = corpus.labelled_text(title=F.col("title"), source=F.col("source"), text=F.col("text"))
    return d.select("doc_id", "lang", text.alias("text_all")).where(F.length("text_all") > 50).select("doc_id", "lang", F.length("text_all").cast("long").alias("n"), F.md5(F.col("text_all").cast("binary")).alias("digest"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.passages(table(spark, sf, "documents"), ["text"])


def chunk_passages(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf).select("passage_id", "doc_id", F.length("passage_text").cast("long").alias("n_chars"), F.md5(F.col("passage_text").cast("binary")).alias("digest"))


def passage_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = _passages(spark, sf).select("doc_id", F.length("passage_text").alias("n"))
    return p.agg(F.count("*").alias("n_passages"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg("n"), 6).alias("mean_chars"), F.round(F.median("n"), 6).alias("median_chars"))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 3).alias("doc_id"), F.col("l_linenumber").alias("rank"), (5 - 100 * F.col("l_discount")).alias("cross"), F.col("l_partkey").alias("part"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    # line numbers repeat in the driver's table: ranks are made unique per case
    rows = _rows(spark, sf)
    return E.group_scores(rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "part", "doc_id", "cross"))))


def group_score(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf)
    return s.select("query_id", "doc_id", "n_passages", F.col("best_rank").cast("long").alias("best_rank"), *[F.round(c, 8).alias(c) for c in ("sum_rrf", "sum_cross", "max_cross", "raw_max_cross", "group_score")])


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return E.selector_signals(_scores(spark, sf).withColumns({c: F.round(c, 6) for c in ("group_score", "raw_max_cross")}))


def selector_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select("query_id", "selected", F.round("share", 4).alias("share"), F.round("raw_max", 4).alias("raw_max"), F.col("best_rank").cast("long").alias("best_rank"), "n_groups", F.when(F.col("n_groups") > 1, F.round("dominance", 3)).alias("dominance"))


def single_group_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "part", "doc_id", "cross")))
    return E.single_group(rows).groupBy("status", "n_groups", "n_kept").agg(F.count("*").alias("cases"), F.round(F.sum(F.round("share", 6)), 3).alias("shares"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with a generic flag and a relevance flag by arithmetic on the key; share and scores rounded, so that thresholds cut alike."""
    s = _signals(spark, sf).withColumns({"share": F.round("share", 4), "dominance": F.round("dominance", 3)})
    return s.withColumns({"generic": F.col("query_id") % 7 == 0, "relevant": F.col("query_id") % 3 == F.col("selected")})


GATE = dict(rho=1.35, tau=0.28, mu=1.0, kappa=2)


def gate_decision(spark: SparkSession, sf: str) -> DataFrame:
    d = E.decision(_cases(spark, sf), E.gates(**GATE, generic="generic"))
    return d.groupBy("status", "failed_gate").agg(F.count("*").alias("cases"), F.sum(F.col("relevant").cast("long")).alias("relevant"))


def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "part", "doc_id", "cross")))
    pool = E.candidate_pool(rows, _signals(spark, sf).select("query_id", "selected"))
    return pool.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"))


def topk_per_group_priority(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("place", E.priority(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]))
    top = E.first_rows(o, ["o_custkey"], [F.asc("place"), F.asc("o_orderkey")], 2)
    return top.select("o_custkey", "o_orderkey", "place", F.col("position").cast("long").alias("position"))


_RHO, _TAU, _MU, _KAPPA = (1.0, 1.2, 1.35, 1.5, 2.0), (0.2, 0.28, 0.4, 0.5), (-4.0, 0.0, 2.0, 4.0), (1, 2, 5)


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.evaluate(_cases(spark, sf), sweep.grid(spark, _RHO, _TAU, _MU, _KAPPA), F.col("relevant"), F.col("generic"))


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf).select("config", "rho", "tau", "mu", "kappa", "accepted", "tp", "precision", "recall", "f1", "unsafety", "generic_abstain_rate")


def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.pareto(_sweep(spark, sf), "f1", "unsafety").select("config", "f1", "unsafety")


def pareto_constrained(spark: SparkSession, sf: str) -> DataFrame:
    """Among settings of precision 0.34 or more: most F1, fewest unsafe accepts."""
    return sweep.pareto(_sweep(spark, sf).where("precision >= 0.34"), "f1", "unsafe").select("config", "f1", "unsafe")


def best_config(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.best_row(_sweep(spark, sf), F.desc("f1"), F.asc("config")).select("config", "rho", "tau", "mu", "kappa", "f1")


def gate_ablation(spark: SparkSession, sf: str) -> DataFrame:
    v = sweep.leave_one_out(_cases(spark, sf), E.gates(**GATE, generic="generic"))
    return v.groupBy("variant").agg(F.count("*").alias("accepted"), F.round(F.avg(F.col("relevant").cast("double")), 6).alias("relevant_rate"))


def gate_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Each variant against all gates: more accepted, and the change of the rate."""
    a = gate_ablation(spark, sf)
    base = a.where("variant = 'all'").select(F.col("accepted").alias("a0"), F.col("relevant_rate").alias("r0"), F.lit(1).alias("_k"))
    return a.withColumn("_k", F.lit(1)).join(F.broadcast(base), "_k").select("variant", (F.col("accepted") - F.col("a0")).alias("more"), F.round(F.col("relevant_rate") - F.col("r0"), 5).alias("rate_delta"))


PHRASES, ANCHORS = ("the of", "in the", "die der"), ("and the",)


def generic_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("flag", generic_flag(F.col("text"), PHRASES, ANCHORS))
    return d.groupBy("lang", "flag").agg(F.count("*").alias("n"))


_SQ = r"trim(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
_SENT = r"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_JOINED = "CASE WHEN acc.open = '' THEN q.open ELSE acc.open || ' ' || q.open END"
_CLOSED = "CASE WHEN acc.open = '' THEN acc.done ELSE list_append(acc.done, acc.open) END"
_CHUNKS = f"""
pieces AS (SELECT doc_id, list_filter({_SENT.format(x=_SQ)}, lambda x: x <> '') AS s FROM documents),
folded AS (SELECT doc_id, list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'open': ''}}, list_transform(s, lambda x: {{'done': CAST([] AS VARCHAR[]), 'open': x}})),
  lambda acc, q: CASE WHEN length({_JOINED}) <= 1200 THEN {{'done': acc.done, 'open': {_JOINED}}}
    WHEN length(q.open) <= 1200 THEN {{'done': {_CLOSED}, 'open': q.open}}
    ELSE {{'done': list_concat({_CLOSED}, list_filter(list_transform(range(0, length(q.open), 1200), lambda i: trim(substr(q.open, i + 1, 1200))), lambda x: x <> '')), 'open': ''}} END) AS f FROM pieces),
packed AS (SELECT doc_id, list_filter(CASE WHEN f.open = '' THEN f.done ELSE list_append(f.done, f.open) END, lambda x: length(x) >= 80) AS p FROM folded),
chunks AS (SELECT doc_id, unnest(p) AS passage_text, unnest(range(len(p))) AS i, doc_id || '::text::' || unnest(range(len(p))) AS passage_id FROM packed)"""
_ROWS = "rows AS (SELECT l_orderkey AS query_id, l_suppkey % 3 AS doc_id, 5 - 100 * l_discount AS cross_, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey % 3, 5 - 100 * l_discount) AS rank FROM lineitem)"
_SCORES = _ROWS + """,
sh AS (SELECT *, cross_ - min(cross_) OVER (PARTITION BY query_id) + 1e-6 AS shift FROM rows),
sco AS (SELECT query_id, doc_id, count(*) AS n_passages, min(rank) AS best_rank, sum(1.0 / (rank + 1)) AS sum_rrf, sum(shift) AS sum_cross, max(shift) AS max_cross, max(cross_) AS raw_max_cross,
  0.45 * sum(1.0 / (rank + 1)) + 0.45 * sum(shift) + 0.10 * count(*) AS group_score FROM sh GROUP BY 1, 2)"""
_SIGNALS = _SCORES + """,
rs AS (SELECT query_id, doc_id, n_passages, best_rank, round(group_score, 6) AS group_score, round(raw_max_cross, 6) AS raw_max_cross FROM sco),
rn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_score DESC, best_rank, doc_id) AS rn FROM rs),
sig AS (SELECT query_id, max(CASE WHEN rn = 1 THEN doc_id END) AS selected, max(CASE WHEN rn = 1 THEN group_score END) / greatest(coalesce(max(CASE WHEN rn = 2 THEN group_score END), 1e-6), 1e-6) AS dominance,
  max(CASE WHEN rn = 1 THEN group_score END) / greatest(sum(group_score), 1e-6) AS share, max(CASE WHEN rn = 1 THEN raw_max_cross END) AS raw_max, max(CASE WHEN rn = 1 THEN best_rank END) AS best_rank, count(*) AS n_groups FROM rn GROUP BY 1)"""
_CASES = _SIGNALS + """,
cas AS (SELECT query_id, selected, round(dominance, 3) AS dominance, round(share, 4) AS share, raw_max, best_rank, query_id % 7 = 0 AS generic, query_id % 3 = selected AS relevant FROM sig)"""
_GATES = {"rho": "dominance >= 1.35", "tau": "share >= 0.28", "mu": "raw_max >= 1.0", "kappa": "best_rank <= 2", "generic": "NOT generic"}
_VARIANTS = " UNION ALL ".join(["SELECT 'all' AS variant, * FROM cas WHERE " + " AND ".join(_GATES.values())] + [f"SELECT 'no_{k}' AS variant, * FROM cas WHERE " + " AND ".join(v for q, v in _GATES.items() if q != k) for k in _GATES])
_values = lambda xs: "unnest([" + ", ".join(map(str, xs)) + "])"
_SWEEP = _CASES + f""",
g0 AS (SELECT * FROM (SELECT {_values(_RHO)} AS rho) CROSS JOIN (SELECT {_values(_TAU)} AS tau) CROSS JOIN (SELECT {_values(_MU)} AS mu) CROSS JOIN (SELECT {_values(_KAPPA)} AS kappa)),
g AS (SELECT row_number() OVER (ORDER BY rho, tau, mu, kappa) - 1 AS config, CAST(rho AS DOUBLE) AS rho, CAST(tau AS DOUBLE) AS tau, CAST(mu AS DOUBLE) AS mu, kappa FROM g0),
ev AS (SELECT config, rho, tau, mu, kappa, CASE WHEN dominance >= rho AND share >= tau AND raw_max >= mu AND best_rank <= kappa AND NOT generic THEN 1 ELSE 0 END AS ok, CAST(relevant AS INT) AS rel, CAST(generic AS INT) AS gen FROM cas CROSS JOIN g),
ag AS (SELECT config, rho, tau, mu, kappa, CAST(sum(ok) AS BIGINT) AS accepted, CAST(sum(ok * rel) AS BIGINT) AS tp, sum(rel) AS positives, CAST(sum(ok * (1 - rel)) AS BIGINT) AS unsafe, sum(gen) AS gen, sum(gen * (1 - ok)) AS gab FROM ev GROUP BY ALL),
pr AS (SELECT *, CASE WHEN accepted = 0 THEN 0 ELSE tp / accepted END AS p, CASE WHEN positives = 0 THEN 0 ELSE tp / positives END AS r FROM ag),
sw AS (SELECT *, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN accepted = 0 THEN 0 ELSE unsafe / accepted END, 6) AS unsafety, round(CASE WHEN gen = 0 THEN 0 ELSE gab / gen END, 6) AS generic_abstain_rate FROM pr)"""

QUERIES = {
    "corpus_build": (corpus_build, f"WITH c AS (SELECT doc_id, lang, 'TITLE: ' || ' ' || 'SOURCE: ' || source || ' TEXT: ' || {_SQ} AS t FROM documents) SELECT doc_id, lang, length(trim(t)) AS n, md5(trim(t)) AS digest FROM c WHERE length(trim(t)) > 50"),
    "sentence_split": (sentence_split, "WITH s AS (SELECT doc_id, " + _SENT.format(x="text") + " AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM s"),
    "chunk_passages": (chunk_passages, "WITH " + _CHUNKS + " SELECT passage_id, doc_id, length(passage_text) AS n_chars, md5(passage_text) AS digest FROM chunks"),
    "passage_stats": (passage_stats, "WITH " + _CHUNKS + " SELECT count(*) AS n_passages, count(DISTINCT doc_id) AS n_docs, round(avg(length(passage_text)), 6) AS mean_chars, round(median(length(passage_text)), 6) AS median_chars FROM chunks"),
    "group_score": (group_score, "WITH " + _SCORES + " SELECT query_id, doc_id, n_passages, best_rank, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("sum_rrf", "sum_cross", "max_cross", "raw_max_cross", "group_score")) + " FROM sco"),
    "selector_signals": (selector_signals, "WITH " + _SIGNALS + " SELECT query_id, selected, round(share, 4) AS share, round(raw_max, 4) AS raw_max, best_rank, n_groups, CASE WHEN n_groups > 1 THEN round(dominance, 3) END AS dominance FROM sig"),
    "single_group_gate": (single_group_gate, "WITH " + _ROWS + """,
per AS (SELECT query_id, doc_id, sum(1.0 / rank) AS weight, count(*) AS n, min(rank) AS best_rank FROM rows GROUP BY 1, 2),
w AS (SELECT *, weight / sum(weight) OVER (PARTITION BY query_id) AS share, count(*) OVER (PARTITION BY query_id) AS n_groups, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, n DESC, best_rank, doc_id) AS rn FROM per)
SELECT CASE WHEN (n < 3 OR share < 0.55) AND n_groups > 1 THEN 'abstain' ELSE 'accept' END AS status, n_groups, least(n, 6) AS n_kept, count(*) AS cases, round(sum(round(share, 6)), 3) AS shares FROM w WHERE rn = 1 GROUP BY 1, 2, 3"""),
    "gate_decision": (gate_decision, "WITH " + _CASES + " SELECT CASE WHEN f = 'none' THEN 'accepted' ELSE 'abstained' END AS status, f AS failed_gate, count(*) AS cases, CAST(sum(CAST(relevant AS INT)) AS BIGINT) AS relevant FROM (SELECT *, CASE " + " ".join(f"WHEN NOT ({v}) THEN '{k}'" for k, v in _GATES.items()) + " ELSE 'none' END AS f FROM cas) GROUP BY 1, 2"),
    "candidate_pool": (candidate_pool, "WITH " + _SIGNALS + """,
o AS (SELECT r.query_id, r.doc_id, min(r.rank) AS rank FROM rows r JOIN sig USING (query_id) WHERE r.doc_id <> sig.selected GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS position FROM o) SELECT * FROM p WHERE position <= 4"""),
    "topk_per_group_priority": (topk_per_group_priority, """WITH o AS (SELECT o_custkey, o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 9 END AS BIGINT) AS place FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY place, o_orderkey) AS position FROM o) SELECT * FROM r WHERE position <= 2"""),
    "threshold_sweep": (threshold_sweep, "WITH " + _SWEEP + " SELECT config, rho, tau, mu, kappa, accepted, tp, precision, recall, f1, unsafety, generic_abstain_rate FROM sw"),
    "pareto_front": (pareto_front, "WITH " + _SWEEP + " SELECT config, f1, unsafety FROM sw a WHERE NOT EXISTS (SELECT 1 FROM sw b WHERE b.f1 >= a.f1 AND b.unsafety <= a.unsafety AND (b.f1 > a.f1 OR b.unsafety < a.unsafety))"),
    "pareto_constrained": (pareto_constrained, "WITH " + _SWEEP + ", ok AS (SELECT * FROM sw WHERE precision >= 0.34) SELECT config, f1, unsafe FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.f1 >= a.f1 AND b.unsafe <= a.unsafe AND (b.f1 > a.f1 OR b.unsafe < a.unsafe))"),
    "best_config": (best_config, "WITH " + _SWEEP + " SELECT config, rho, tau, mu, kappa, f1 FROM sw ORDER BY f1 DESC, config LIMIT 1"),
    "gate_ablation": (gate_ablation, "WITH " + _CASES + ", v AS (" + _VARIANTS + ") SELECT variant, count(*) AS accepted, round(avg(CAST(relevant AS INT)), 6) AS relevant_rate FROM v GROUP BY 1"),
    "gate_delta": (gate_delta, "WITH " + _CASES + ", v AS (" + _VARIANTS + "), a AS (SELECT variant, count(*) AS accepted, round(avg(CAST(relevant AS INT)), 6) AS r FROM v GROUP BY 1) SELECT a.variant, a.accepted - b.accepted AS more, round(a.r - b.r, 5) AS rate_delta FROM a, a b WHERE b.variant = 'all'"),
    "generic_flags": (generic_flags, "SELECT lang, (contains(lower(text), 'the of') OR contains(lower(text), 'in the') OR contains(lower(text), 'die der')) AND NOT contains(lower(text), 'and the') AS flag, count(*) AS n FROM documents GROUP BY 1, 2"),
}
