"""Queries of leak detection, guards, redaction, sampling and resumable logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, text as T
from ..functions.scoring import batch_scorer
from ..operators import guard as G, redact as R, sampling as S
from .base import table

_FALLBACK = "Not stated in the evidence."


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as answers: every fifth names the next document's identifier too."""
    d = table(spark, sf, "documents")
    own = F.concat(F.lit("DOC"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    nxt = F.concat(F.lit("DOC"), F.lpad((F.col("doc_id") + 1).cast("string"), 8, "0"))
    return d.select("doc_id", "source", own.alias("own"), F.concat_ws(" ", "text", F.lower(own), F.when(F.col("doc_id") % 5 == 0, nxt)).alias("answer"))


def narrow_leak(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf)
    return a.select("doc_id", G.narrow_leaks(F.col("answer"), F.col("own"), r"(?i)DOC\d{8}").alias("narrow"), G.narrow_leaks(F.col("answer"), F.col("own"), r"DOC\d{8}", keep_case=True).alias("exact_case"))


def narrow_leak_summary(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf).select("source", (G.narrow_leaks(F.col("answer"), F.col("own"), r"(?i)DOC\d{8}") > 0).alias("leak"))
    return a.groupBy("source").agg(F.count("*").alias("n"), F.count_if("leak").alias("leaks"), F.round(F.avg(F.col("leak").cast("double")), 6).alias("rate"))


def distinctive_vocab(spark: SparkSession, sf: str) -> DataFrame:
    v = G.distinctive_terms(table(spark, sf, "documents"), cap=5)
    return v.select("doc_id", F.array_join("tokens", "|").alias("tokens"))


def wide_leak(spark: SparkSession, sf: str) -> DataFrame:
    """Answers are benchmark passages; a pool is five of all documents by arithmetic."""
    n = table(spark, sf, "documents").count()
    b = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("answer"))
    pool = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.pmod(F.col("item_id") * 7919 + i * 1301, F.lit(n)).cast("long"))
    a = b.select("item_id", "answer", F.pmod(F.col("item_id") * 7919, F.lit(n)).alias("own"), pool.alias("pool"))
    asked = a.select(F.explode("pool").alias("doc_id"))
    return G.wide_leaks(a, G.distinctive_terms(table(spark, sf, "documents"), of=asked), "item_id")


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as claims: supports are line numbers, of which four are allowed."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("supports"))
    claim = F.when(F.col("l_orderkey") % 11 == 0, F.lit("")).when(F.col("l_orderkey") % 7 == 0, F.lit(_FALLBACK)).when(F.col("l_orderkey") % 3 == 0, F.lit("The risk is stated.")).otherwise(F.lit("The visit takes a day."))
    return li.select("l_orderkey", claim.alias("claim"), F.when(F.col("l_orderkey") % 13 == 0, F.array().cast("array<int>")).otherwise(F.col("supports")).alias("supports"), F.array(*[F.lit(i) for i in (1, 2, 3, 4)]).alias("allowed"))


def citation_validate(spark: SparkSession, sf: str) -> DataFrame:
    e = G.citation_errors(F.col("claim"), F.col("supports"), F.col("allowed"), _FALLBACK, ["risk"])
    return _cited(spark, sf).select("l_orderkey", F.array_join(e, ";").alias("errors"))


def citation_postprocess(spark: SparkSession, sf: str) -> DataFrame:
    c = _cited(spark, sf).select("l_orderkey", G.corrected(F.col("claim"), F.col("supports"), F.col("allowed"), _FALLBACK, ["risk"]).alias("c"))
    return c.select("l_orderkey", "c.claim", F.array_join(F.transform("c.supports", lambda x: x.cast("string")), ",").alias("supports"), "c.change")


def hard_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = _cited(spark, sf)
    return c.select("l_orderkey", G.hard_gate(F.col("claim"), F.col("supports"), F.col("allowed"), _FALLBACK).alias("claim"), G.supports_in(F.col("supports"), 4).alias("in_range"))


def unclear_list(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    lists = n.select("n_regionkey", F.transform("names", lambda x: F.concat(F.lit(" "), F.lower(x), F.lit(".."))).alias("missing"), F.concat(F.slice("names", 1, 2), F.array(F.lit(" . "), F.lit("other"))).alias("unresolved"))
    return lists.select("n_regionkey", F.concat_ws(" ; ", G.unclear_items(F.col("missing"), F.col("unresolved"))).alias("items"))


_RULES = (("steel", "Which %s do you mean?"), ("brass", "Is it brass?"), ("tin", "How much %s is there?"))


def teachback_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", G.question(F.concat(F.col("p_type"), F.lit(".")), _RULES, "What is %s?").alias("question"))


def claim_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return R.extracted(d, "doc_id", ["body"], _FALLBACK).select("doc_id", F.col("position").cast("long").alias("position"), F.md5(F.col("claim").cast("binary")).alias("digest"))


def _claims_and_evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every assistant turn's sentences as claims; users' turns of its conversation are its own evidence, those of the next one the other."""
    c = table(spark, sf, "conversations")
    claims = R.extracted(c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("body")), ["conv_id", "turn"], ["body"], _FALLBACK)
    said = c.where("role = 'user'")
    part = lambda shift, grp: said.select((F.col("conv_id") - shift).alias("conv_id"), F.lit(grp).alias("grp"), F.lit("s").alias("sel"), "text", "turn")
    return claims, R.premises(part(0, "s").unionAll(part(1, "o")), "conv_id", "grp", "sel", "text", "turn", 600)


def _redacted(scored: DataFrame) -> DataFrame:
    r = R.rebuilt(scored, ["conv_id", "turn"], 0.3, _FALLBACK)
    return r.select("conv_id", "turn", "field", F.md5(F.col("text").cast("binary")).alias("digest"), "n_dropped")


def claim_redact(spark: SparkSession, sf: str) -> DataFrame:
    return _redacted(R.scored(*_claims_and_evidence(spark, sf), "conv_id"))


def _terms_shared(premises, claims):
    """The share of each claim's distinct terms that its premise has; stands for an entailment model."""
    words = [(set(re.findall("[a-z0-9]+", p.lower())), set(re.findall("[a-z0-9]+", c.lower()))) for p, c in zip(premises, claims, strict=True)]
    return [len(p & c) / len(c) if c else 0.0 for p, c in words]


def claim_redact_model(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a scorer that takes batches of (premise, claim)."""
    return _redacted(R.scored_by_model(*_claims_and_evidence(spark, sf), "conv_id", batch_scorer(lambda: _terms_shared)))


def redact_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    return R.calibrated(R.scored(*_claims_and_evidence(spark, sf), "conv_id"), [x / 100 for x in range(5, 100, 5)])


def flatten_nested(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.struct(F.col("o_orderkey").alias("id"), F.struct("o_orderstatus", F.array("o_orderpriority", F.col("o_orderstatus")).alias("tags")).alias("info")).alias("doc"))
    return o.select(F.col("doc.id").alias("o_orderkey"), F.col("doc.info.o_orderstatus").alias("status"), F.concat_ws(" ; ", "doc.info.tags").alias("tags"))


def field_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"))
    after = s.withColumn("nation", F.when(F.col("s_suppkey") % 3 == 0, F.lit("x")).otherwise(F.col("nation"))).where("s_suppkey % 5 <> 0")
    return G.field_diff(s, after, "s_suppkey", ["s_name", "nation"])


def canonical_decisions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    raw = F.when(F.col("p_size") % 4 == 0, " Likely Match ").when(F.col("p_size") % 4 == 1, "it is an unlikely_match, I think").when(F.col("p_size") % 4 == 2, F.col("p_type"))
    return p.select("p_partkey", jsonx.canonical_choice(raw, ["likely_match", "unlikely_match", "possible_match"], "cannot_determine").alias("decision"))


def parsed_json(spark: SparkSession, sf: str) -> DataFrame:
    """Objects out of fenced text, by the outer braces and by the first that closes."""
    e = table(spark, sf, "events")
    raw = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"), F.when(F.col("event_id") % 2 == 0, F.lit(' then {"k": 0}')).otherwise(F.lit("")))
    return e.select("event_id", jsonx.parsed(raw, "k INT")["k"].cast("long").alias("outer"), F.from_json(jsonx.first_object(raw), "k INT")["k"].cast("long").alias("first"), jsonx.score_in(F.from_json("props", "k INT")["k"]).cast("long").alias("score"))


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return S.quotas(c, "c_custkey", F.col("c_mktsegment"), {"BUILDING": 5, "MACHINERY": 3}, 12, seed=7).select("c_custkey", "stratum", "in_quota")


def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.sampled(table(spark, sf, "orders"), "o_orderkey", 30, seed=42).select("o_orderkey")


def blind_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return S.blinded(n, "n_nationkey", "packet").select("n_nationkey", "blind_id", F.col("order").cast("long").alias("order"))


def _failed() -> Column:
    return F.col("event_type") == "error"


def jsonl_compact(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return S.compacted(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], _failed()).select("user_id", "event_id", "event_type")


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    work = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return S.to_do(work, e, ["user_id"], _failed())


_ANS = "a AS (SELECT doc_id, source, 'DOC' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS own, text || ' ' || lower('DOC' || lpad(CAST(doc_id AS VARCHAR), 8, '0')) || CASE WHEN doc_id % 5 = 0 THEN ' DOC' || lpad(CAST(doc_id + 1 AS VARCHAR), 8, '0') ELSE '' END AS answer FROM documents)"
_NARROW = r"len(list_filter(list_distinct(list_transform(regexp_extract_all(answer, '(?i)DOC\d{8}'), lambda x: upper(x))), lambda x: x <> own))"
_WORDS = r"w AS (SELECT DISTINCT doc_id, unnest(list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: regexp_replace(w, '^[.,;:()]+|[.,;:()]+$', '', 'g')), lambda w: regexp_full_match(w, '\p{L}{6,}'))) AS w FROM documents), o AS (SELECT w, min(doc_id) AS doc_id FROM w GROUP BY 1 HAVING count(*) = 1)"
_CITED = f"""c AS (SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN '' WHEN l_orderkey % 7 = 0 THEN '{_FALLBACK}' WHEN l_orderkey % 3 = 0 THEN 'The risk is stated.' ELSE 'The visit takes a day.' END AS claim,
 CASE WHEN l_orderkey % 13 = 0 THEN CAST([] AS INT[]) ELSE list_sort(list_distinct(list(l_linenumber))) END AS supports FROM lineitem GROUP BY 1)"""
_ERR = lambda s: f"list_filter([CASE WHEN claim = '' THEN 'missing claim' END, CASE WHEN claim NOT IN ('', '{_FALLBACK}') AND len({s}) = 0 THEN 'no supports' END, CASE WHEN claim NOT IN ('', '{_FALLBACK}') AND len(list_filter({s}, lambda x: x > 4)) > 0 THEN 'unknown support' END, CASE WHEN claim NOT IN ('', '{_FALLBACK}') AND NOT contains(lower(claim), 'risk') THEN 'no field keyword' END], lambda x: x IS NOT NULL)"
_HASH = lambda *k: "CAST('0x' || substr(md5(" + " || '-' || ".join(f"CAST({x} AS VARCHAR)" for x in k) + "), 1, 8) AS BIGINT)"

_TERM = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
#: Claims with the best overlap over chunks of at most 600 characters; a chunk's terms are its pieces', as a line break joins them.
_SCORED_CLAIMS = f"""
cl AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS c FROM conversations WHERE role = 'assistant'),
claims AS (SELECT * FROM (SELECT conv_id, turn, unnest(range(len(c))) AS position, unnest(c) AS claim FROM cl) WHERE claim <> '{_FALLBACK}'),
said AS (SELECT conv_id, 'own' AS side, turn, text FROM conversations WHERE role = 'user' AND text <> '' UNION ALL SELECT conv_id - 1, 'other', turn, text FROM conversations WHERE role = 'user' AND text <> ''),
pc AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, text) AS i FROM said),
fold AS (
  SELECT conv_id, side, i, text, 1 AS chunk, CASE WHEN length(text) > 600 THEN 0 ELSE length(text) END AS open FROM pc WHERE i = 1
  UNION ALL SELECT p.conv_id, p.side, p.i, p.text, CASE WHEN f.open > 0 AND f.open + 1 + length(p.text) <= 600 THEN f.chunk ELSE f.chunk + 1 END,
    CASE WHEN f.open > 0 AND f.open + 1 + length(p.text) <= 600 THEN f.open + 1 + length(p.text) WHEN length(p.text) > 600 THEN 0 ELSE length(p.text) END
  FROM fold f JOIN pc p ON p.conv_id = f.conv_id AND p.side = f.side AND p.i = f.i + 1),
blocks AS (SELECT conv_id, side, chunk, CASE WHEN length(text) > 600 THEN b ELSE 0 END AS block, CASE WHEN length(text) > 600 THEN substr(text, CAST(b * 600 + 1 AS BIGINT), 600) ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN length(text) > 600 THEN (length(text) + 599) // 600 ELSE 1 END)) AS b FROM fold)),
chunks AS (SELECT conv_id, side, list_distinct(flatten(list({_TERM.format("text")}))) AS terms FROM blocks GROUP BY conv_id, side, chunk, block),
sc AS (SELECT c.conv_id, c.turn, c.position, c.claim,
    coalesce(max(CASE WHEN side = 'own' THEN coalesce(len(list_intersect({_TERM.format("claim")}, terms)) / nullif(len({_TERM.format("claim")}), 0), 0) END), 0) AS e_own,
    coalesce(max(CASE WHEN side = 'other' THEN coalesce(len(list_intersect({_TERM.format("claim")}, terms)) / nullif(len({_TERM.format("claim")}), 0), 0) END), 0) AS e_other
  FROM claims c LEFT JOIN chunks k ON k.conv_id = c.conv_id GROUP BY 1, 2, 3, 4)"""
_REDACT = _SCORED_CLAIMS + f""" SELECT conv_id, turn, 'body' AS field, md5(CASE WHEN count(*) FILTER (NOT (e_other >= 0.3 AND e_other > e_own)) = 0 THEN '{_FALLBACK}' ELSE string_agg(claim, ' ' ORDER BY position) FILTER (NOT (e_other >= 0.3 AND e_other > e_own)) END) AS digest,
  count(*) FILTER (e_other >= 0.3 AND e_other > e_own) AS n_dropped FROM sc GROUP BY 1, 2"""

QUERIES = {
    "narrow_leak": (narrow_leak, f"WITH {_ANS} SELECT doc_id, {_NARROW} AS narrow, len(list_filter(list_distinct(regexp_extract_all(answer, 'DOC\\d{{8}}')), lambda x: x <> own)) AS exact_case FROM a"),
    "narrow_leak_summary": (narrow_leak_summary, f"WITH {_ANS} SELECT source, count(*) AS n, count(*) FILTER ({_NARROW} > 0) AS leaks, round(avg(CAST({_NARROW} > 0 AS INT)), 6) AS rate FROM a GROUP BY 1"),
    "distinctive_vocab": (distinctive_vocab, f"WITH {_WORDS} SELECT doc_id, array_to_string(list_slice(list(w ORDER BY w), 1, 5), '|') AS tokens FROM o GROUP BY 1"),
    "wide_leak": (wide_leak, f"WITH {_WORDS}, b AS (SELECT CAST(item_id AS BIGINT) AS item_id, lower(text) AS answer, item_id * 7919 % (SELECT count(*) FROM documents) AS own FROM benchmark), p AS (SELECT b.*, (item_id * 7919 + i * 1301) % (SELECT count(*) FROM documents) AS doc FROM b, (SELECT unnest(range(5)) AS i)) SELECT b.item_id, CAST(coalesce(max(CAST(contains(p.answer, o.w) AS INT)), 0) AS BIGINT) AS wide FROM b LEFT JOIN p ON p.item_id = b.item_id AND p.doc <> p.own LEFT JOIN o ON o.doc_id = p.doc GROUP BY 1"),
    "citation_validate": (citation_validate, f"WITH {_CITED} SELECT l_orderkey, array_to_string({_ERR('supports')}, ';') AS errors FROM c"),
    "citation_postprocess": (citation_postprocess, f"WITH {_CITED}, k AS (SELECT *, list_filter(supports, lambda x: x <= 4) AS kept FROM c), e AS (SELECT *, {_ERR('kept')} AS err FROM k) SELECT l_orderkey, CASE WHEN len(err) > 0 THEN '{_FALLBACK}' ELSE claim END AS claim, CASE WHEN len(err) > 0 THEN '' ELSE array_to_string(kept, ',') END AS supports, CASE WHEN len(err) > 0 THEN err[1] WHEN len(kept) < len(supports) THEN 'dropped supports' ELSE '' END AS change FROM e"),
    "hard_gate": (hard_gate, f"WITH {_CITED} SELECT l_orderkey, CASE WHEN len(list_filter(supports, lambda x: x > 4)) > 0 THEN '{_FALLBACK}' ELSE claim END AS claim, len(supports) > 0 AND len(list_filter(supports, lambda x: x > 4)) = 0 AS in_range FROM c"),
    "unclear_list": (unclear_list, "WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) SELECT n_regionkey, string_agg(upper(substr(n_name, 1, 1)) || substr(lower(n_name), 2), ' ; ' ORDER BY i) || ' ; Other' AS items FROM n GROUP BY 1"),
    "teachback_rules": (teachback_rules, "SELECT p_partkey, CASE WHEN contains(t, 'steel') THEN 'Which ' || t || ' do you mean?' WHEN contains(t, 'brass') THEN 'Is it brass?' WHEN contains(t, 'tin') THEN 'How much ' || t || ' is there?' ELSE 'What is ' || t || '?' END AS question FROM (SELECT p_partkey, lower(p_type) AS t FROM part)"),
    "claim_extract": (claim_extract, f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS c FROM documents),
p AS (SELECT doc_id, unnest(c) AS claim, unnest(range(len(c))) AS position FROM s) SELECT doc_id, position, md5(claim) AS digest FROM p WHERE claim <> '{_FALLBACK}'"""),
    "claim_redact": (claim_redact, "WITH RECURSIVE " + _REDACT),
    "claim_redact_model": (claim_redact_model, "WITH RECURSIVE " + _REDACT),
    "redact_calibrate": (redact_calibrate, "WITH RECURSIVE " + _SCORED_CLAIMS + " SELECT coalesce(max(t) FILTER (rate <= 0.10), CAST(0.5 AS DOUBLE)) AS threshold FROM (SELECT t, avg(CASE WHEN e_other >= t AND e_other > e_own THEN 1.0 ELSE 0.0 END) AS rate FROM sc, (SELECT CAST(unnest(range(5, 100, 5)) AS DOUBLE) / 100 AS t) GROUP BY 1)"),
    "flatten_nested": (flatten_nested, "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority || ' ; ' || o_orderstatus AS tags FROM orders"),
    "field_diff": (field_diff, "WITH s AS (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier) SELECT s_suppkey, 'nation' AS field, nation AS before, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'x' END AS after FROM s WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 's_name', s_name, NULL FROM s WHERE s_suppkey % 5 = 0"),
    "canonical_decisions": (canonical_decisions, "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'likely_match' WHEN 1 THEN 'likely_match' ELSE 'cannot_determine' END AS decision FROM part"),
    "parsed_json": (parsed_json, """SELECT event_id, CASE WHEN event_id % 2 = 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS "outer", CAST(json_extract_string(props, '$.k') AS BIGINT) AS first, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 1 AND 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS score FROM events"""),
    "stratified_sample": (stratified_sample, f"WITH h AS (SELECT c_custkey, c_mktsegment AS stratum, {_HASH(7, 'c_custkey')} AS d FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY d, c_custkey) AS rn FROM h), q AS (SELECT *, rn <= CASE stratum WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 3 ELSE 0 END AS in_quota FROM r) SELECT c_custkey, stratum, in_quota FROM q ORDER BY in_quota DESC, d, c_custkey LIMIT 12"),
    "random_sample": (random_sample, f"SELECT o_orderkey FROM orders ORDER BY {_HASH(42, 'o_orderkey')}, o_orderkey LIMIT 30"),
    "blind_ids": (blind_ids, "SELECT n_nationkey, substr(sha1('packet:' || n_nationkey), 1, 10) AS blind_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('packet-order-' || n_nationkey), 1, 8) AS BIGINT), n_nationkey) AS order FROM nation".replace("AS order FROM", 'AS "order" FROM')),
    "jsonl_compact": (jsonl_compact, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1"),
    "resume_antijoin": (resume_antijoin, "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')"),
}
