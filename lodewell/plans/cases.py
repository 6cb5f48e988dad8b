"""Queries of judge prompts, other candidates, wide case rows, coverage, headlines, and small column rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.intervals import clamp
from ..operators import agreement as A, cases as K, corpus, evidence as E, guard as G, retrieval as R
from ..shared import written
from .base import BM25, exact_interval, qrels, table, topics
from .casework import _STATUS, _TERMS
from .evidence import _CHUNKS, _SENT, _SQ, ANCHORS, PHRASES, _cases, _passages, _rows
from .guards import _HASH

TEMPLATE = "Selected document {selected}\n{own}\n\n{n} others:\n{candidates}\n\nAnswer:\n{answer}\n"
HEAD, NOTHING = "### Other document", "(no others were found)"
TEMPLATES = {"direct": "May I take part?", "unsure": "What should I ask first?"}


def _sections(docs: DataFrame) -> DataFrame:
    """Passages with sections by their place in the document."""
    i = F.col("i")
    return corpus.passages(docs, ["text"]).withColumn("section", F.when(i == 0, "brief_summary").when(i % 3 == 1, "eligibility").when(i % 3 == 2, "methods").otherwise("primary_outcome"))


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected, candidates, passages): the first document of each topic is selected; even topics have scored passages.

    Passages are asked for of documents of the run only, so no others are cut into them;
    what is used several times is written once.
    """
    asked, docs = topics(spark, sf), table(spark, sf, "documents")
    run = written(R.bm25(docs, asked, 20), "run")
    p = written(_sections(docs.join(run.select("doc_id").distinct(), "doc_id", "left_semi")), "passages")
    scored = written(R.passage_search(run.where("query_id % 2 = 0"), p, asked).select("query_id", "doc_id", "passage_id", "score"), "scored")
    selected = run.where("rank = 1").select("query_id", F.col("doc_id").alias("selected"))
    return selected, K.candidates(selected, scored.join(p.select("passage_id", "passage_text"), "passage_id"), run, p), p


def candidate_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Each topic's four best documents beside the first, with two passages each."""
    _, found, _ = _found(spark, sf)
    return found.select("query_id", "doc_id", "route", F.col("position").cast("long").alias("position"), F.size("passages").cast("long").alias("n"), F.md5(F.array_join("passages", "\n").cast("binary")).alias("digest"))


def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt for each topic: the selected document's passages, the other candidates', and the topic's text as answer."""
    selected, found, p = _found(spark, sf)
    own = K.looked_up(selected.select(F.col("selected").alias("doc_id")), p, 2).select(F.col("doc_id").alias("selected"), F.array_join("passages", "\n").alias("own"))
    cases = selected.join(own, "selected", "left").join(topics(spark, sf).withColumnRenamed("text", "answer"), "query_id")
    out = K.prompts(cases, found, TEMPLATE, HEAD, NOTHING)
    return out.select("query_id", "n_candidates", F.length("prompt").cast("long").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("digest"))


def question_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Each topic as a question, and with other tails."""
    asked = topics(spark, sf).select("query_id", K.filled("This is my case: {case} Am I eligible?", case=T.squash(F.col("text"))).alias("question"))
    tails = F.explode(F.array(*[F.struct(F.lit(k).alias("intent"), F.lit(v).alias("tail")) for k, v in TEMPLATES.items()]))
    return asked.select("query_id", "question", tails.alias("v")).select("query_id", "v.intent", K.retold(F.col("question"), "Am I eligible?", F.col("v.tail")).alias("question"))


def premise_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's sentences on lines, in texts of at most 1800 characters."""
    d = table(spark, sf, "documents").select("doc_id", T.packed_lines(T.sentences(T.squash(F.col("text")))).alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|").cast("binary")).alias("digest"))


def generic_flag_quality(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase rule as a detector of toxic documents, by language."""
    d = table(spark, sf, "documents").select("doc_id", "lang", T.generic_flag(F.col("text"), PHRASES, ANCHORS).alias("flag"))
    return K.flag_quality(d.join(table(spark, sf, "labels"), "doc_id"), F.col("flag"), F.col("toxic") == 1, ["lang"])


def missed_utility(spark: SparkSession, sf: str) -> DataFrame:
    """What abstaining cost, with exact intervals; gold is a supplier class by arithmetic."""
    d = E.decision(_cases(spark, sf), E.gates(1.35, 0.28, 1.0, 2, generic="generic")).withColumn("gold", F.col("query_id") % 3)
    out = K.missed_utility(d.withColumn("flag", F.col("query_id") % 5 == 0), _rows(spark, sf), flag="flag")
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


_FIELDS = tuple(dict.fromkeys(f for fields in A.DIMENSIONS.values() for f in fields))
_SAID = ("Yes", " partial", "no", "HIGH", "severe", "?")


def rubric_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """All rubric fields by arithmetic, as five dimensions by their mean, least and greatest level."""
    word = lambda i: F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.floor(F.col("c_custkey") / (i + 1)) % len(_SAID) + 1).cast("int"))
    sheet = table(spark, sf, "customer").select("c_custkey", *[word(i).alias(f) for i, f in enumerate(_FIELDS)])
    ways = [sheet.select("c_custkey", F.lit(how).alias("how"), *[c.cast("double").alias(d) for d, c in A.judged_dimensions(sheet, how).items()]) for how in ("mean", "min", "max")]
    return ways[0].unionByName(ways[1]).unionByName(ways[2])


def headline_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Labels' means by language: overall, and of each dimension."""
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") / 1000).alias("length"))
    rows = d.join(table(spark, sf, "labels"), "doc_id").select("lang", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"), "length")
    out = K.headline(rows.unpivot(["lang"], ["quality", "toxic", "length"], "dim", "x"), "lang", "dim", "x")
    return out.select("lang", "n", "overall", F.array_join(F.transform(F.map_entries("per_dim"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"]))), ";").alias("per_dim"))


def coverage_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The run's rows after the documents' passages are merged; documents under 80 characters have none."""
    run = R.bm25(table(spark, sf, "documents"), topics(spark, sf), 100)
    return K.coverage(run, R.concatenated(_passages(spark, sf)), qrels(spark, sf))


def case_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Four JSON documents of each order, some missing, as one wide row."""
    o = table(spark, sf, "orders").withColumn("case_id", F.col("o_orderkey"))
    flags = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    read = lambda df, body, ddl: df.select("case_id", F.from_json(F.to_json(body), ddl).alias("body"))
    parts = {
        "context": read(o, F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("selected")), "status STRING, selected BIGINT"),
        "assessment": read(o.where("o_orderkey % 5 <> 0").join(flags, "case_id"), F.struct(F.col("o_orderpriority").alias("decision"), F.col("flags").alias("missing")), "decision STRING, missing ARRAY<STRING>"),
        "explanation": read(o.where("o_orderkey % 3 <> 0"), F.struct(F.struct(F.col("o_orderpriority").alias("text")).alias("purpose")), "purpose STRUCT<text: STRING>, risks STRUCT<text: STRING>"),
        "questions": read(flags.where("case_id % 2 = 0"), F.struct(F.transform("flags", lambda x: F.concat(x, F.lit("?"))).alias("asked")), "asked ARRAY<STRING>"),
    }
    return K.wide_record(o.select("case_id"), parts, {"status": "context.status", "selected": "context.selected", "decision": "assessment.decision"}, {"purpose": "explanation.purpose", "risks": "explanation.risks"}, {"missing": "assessment.missing", "asked": "questions.asked"})


def summary_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    none = lambda c, n: F.when(F.col("o_orderkey") % n != 0, F.col(c)).otherwise(F.lit("Not stated."))
    unclear = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit(" NOT stated."), F.col("o_orderpriority"), F.lit(" ")))
    return o.select("o_orderkey", K.rebuilt_summary({"Status": none("o_orderstatus", 3), "Urgency": none("o_orderpriority", 5)}, unclear, "Not stated.").alias("summary"))


def truth_values(spark: SparkSession, sf: str) -> DataFrame:
    """Written truth values of many forms, counted by what they mean."""
    e = table(spark, sf, "events")
    said = F.get(F.array(*[F.lit(x) for x in ("true", "YES ", "0", None, "T", "1.0", "no", "2")]), (F.col("event_id") % 8).cast("int"))
    return e.groupBy(F.col("event_type"), T.truth(said).alias("yes")).agg(F.count("*").alias("n"))


def slug_join(spark: SparkSession, sf: str) -> DataFrame:
    """Names written for files, joined with the names themselves."""
    name = F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand"))
    p = table(spark, sf, "part").select(name.alias("name"), "p_size")
    files = p.groupBy(T.unslug_first(F.replace("name", F.lit("/"), F.lit("__"))).alias("name")).agg(F.count("*").alias("files"))
    return files.join(p.groupBy("name").agg(F.sum("p_size").cast("long").alias("size")), "name")


def clamped(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_returnflag", clamp(F.col("l_quantity") / 30 - 0.2).alias("x"))
    return li.groupBy("l_returnflag").agg(F.count_if(F.col("x") == 0).alias("low"), F.count_if(F.col("x") == 1).alias("high"), F.round(F.avg("x"), 6).alias("mean"))


def alternating_draw(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty orders, in turn from each status."""
    out = K.ranked_in_turn(table(spark, sf, "orders"), "o_orderstatus", [T.draw(F.col("o_orderkey")), F.col("o_orderkey")], 50)
    return out.select("o_orderkey", "o_orderstatus", F.col("place").cast("long").alias("place"))


def interval_cells(spark: SparkSession, sf: str) -> DataFrame:
    four = lambda c: T.four_decimals(F.round(c, 4))
    cell = F.concat(four(F.avg("o_totalprice")), F.lit(" ["), four(F.min("o_totalprice")), F.lit(","), four(F.max("o_totalprice")), F.lit("]"))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(cell.alias("cell"))


def pattern_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in which any of a list of patterns is found."""
    d = table(spark, sf, "documents").withColumn("hit", T.matches_any(F.col("text"), [r"[0-9]{4}-[0-9]{2}", r"(licen[cs]e|LICEN[CS]E)", r"@[a-z]+\."]))
    return d.groupBy("source", "hit").agg(F.count("*").alias("n"))


def first_texts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a, b = F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    return o.groupBy(T.first_text(a, b).alias("said")).agg(F.count("*").alias("n"))


def topic_areas(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy(G.other_if_unknown(F.col("lang"), ["en", "de"]).alias("area"))
    return d.agg(F.count("*").alias("n"), F.sum(F.col("n_chars").cast("long")).alias("chars"))


_FOUND = BM25 + "," + _CHUNKS + f""",
top AS (SELECT query_id, doc_id, score AS doc_score, rank FROM bm WHERE rank <= 20), sel AS (SELECT query_id, doc_id AS selected FROM top WHERE rank = 1),
sec AS (SELECT doc_id, passage_id, CASE WHEN length(passage_text) <= 700 THEN passage_text ELSE substr(passage_text, 1, 700) || '…' END AS short, CASE WHEN i = 0 OR i % 3 = 1 THEN CAST(i = 0 AS INT) WHEN i % 3 = 2 THEN 9 ELSE 3 END AS place FROM chunks),
ps AS (SELECT top.query_id, doc_id, passage_id, doc_score, round(len(list_intersect({_TERMS}, regexp_extract_all(lower(passage_text), '[a-z0-9]+'))) / len({_TERMS}), 6) AS score FROM chunks JOIN top USING (doc_id) JOIN topics t ON t.query_id = top.query_id WHERE top.query_id % 2 = 0),
pk AS (SELECT query_id, doc_id, passage_id, score FROM ps QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_score DESC, passage_id) <= 8),
b1 AS (SELECT pk.* FROM pk JOIN sel USING (query_id) WHERE doc_id <> selected QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, passage_id) = 1),
p1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM b1),
p2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM top JOIN sel USING (query_id) WHERE doc_id <> selected AND query_id NOT IN (SELECT query_id FROM pk)),
lk AS (SELECT doc_id, list(short ORDER BY place, passage_id)[1:2] AS ts FROM sec GROUP BY 1),
r1 AS (SELECT query_id, position, doc_id, 'scored' AS route, CASE WHEN substr(sec.short, 1, 80) = substr(lk.ts[1], 1, 80) THEN [sec.short] ELSE [sec.short, lk.ts[1]] END AS ts FROM p1 JOIN sec USING (doc_id, passage_id) JOIN lk USING (doc_id) WHERE position <= 4),
cnd AS (SELECT * FROM r1 UNION ALL SELECT query_id, position, doc_id, 'run', ts FROM p2 JOIN lk USING (doc_id) WHERE position <= 4)"""
_BY = {k: [(f, inv) for f, inv in v.items()] for k, v in A.DIMENSIONS.items()}


def _level(field: str, inverted: bool) -> str:
    given = {w: (A.INVERTED_LEVELS if inverted else A.LEVELS).get(w.strip().lower()) for w in _SAID}
    return f"CASE c_custkey // {_FIELDS.index(field) + 1} % {len(_SAID)} " + " ".join(f"WHEN {i} THEN {given[w]}" for i, w in enumerate(_SAID) if given[w]) + " END"


def _dimensions(how: str, fold: str) -> str:
    cols = ", ".join(f"CAST({fold}(list_filter([{', '.join(_level(f, inv) for f, inv in fields)}], lambda x: x IS NOT NULL)) AS DOUBLE) AS {d}" for d, fields in _BY.items())
    return f"SELECT c_custkey, '{how}' AS how, {cols} FROM customer"


QUERIES = {
    "candidate_passages": (candidate_passages, "WITH " + _FOUND + " SELECT query_id, doc_id, route, position, len(ts) AS n, md5(array_to_string(ts, chr(10))) AS digest FROM cnd"),
    "judge_prompts": (judge_prompts, "WITH " + _FOUND + f""",
bl AS (SELECT query_id, count(*) AS n, string_agg('{HEAD} ' || doc_id || chr(10) || array_to_string(list_transform(ts, lambda x: '- ' || x || chr(10)), ''), chr(10) ORDER BY position) AS b FROM cnd GROUP BY 1),
pr AS (SELECT query_id, coalesce(n, 0) AS n_candidates, 'Selected document ' || selected || chr(10) || coalesce(nullif(trim(array_to_string(lk.ts, chr(10))), ''), '(empty)') || chr(10) || chr(10) || coalesce(n, 0) || ' others:' || chr(10) || coalesce(b, '{NOTHING}') || chr(10) || chr(10) || 'Answer:' || chr(10)
  || CASE WHEN coalesce(trim(t.text), '') = '' THEN '(empty)' WHEN length(trim(t.text)) <= 5000 THEN trim(t.text) ELSE substr(trim(t.text), 1, 5000) || '…' END || chr(10) AS prompt
  FROM sel JOIN topics t USING (query_id) LEFT JOIN bl USING (query_id) LEFT JOIN lk ON lk.doc_id = sel.selected)
SELECT query_id, n_candidates, length(prompt) AS n_chars, md5(prompt) AS digest FROM pr"""),
    "question_variants": (question_variants, "SELECT CAST(item_id AS BIGINT) AS query_id, intent, trim(split_part('This is my case: ' || " + _SQ + " || ' Am I eligible?', 'Am I eligible?', 1)) || ' ' || tail AS question FROM benchmark CROSS JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items()) + ") v(intent, tail)"),
    "premise_chunks": (premise_chunks, "WITH s AS (SELECT doc_id, list_filter(" + _SENT.format(x=_SQ) + """, lambda x: x <> '') AS s FROM documents),
f AS (SELECT doc_id, list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'open': ''}, list_transform(s, lambda x: {'done': CAST([] AS VARCHAR[]), 'open': x})),
  lambda acc, q: CASE WHEN acc.open = '' THEN {'done': acc.done, 'open': q.open} WHEN length(acc.open) + length(q.open) + 1 > 1800 THEN {'done': list_append(acc.done, acc.open), 'open': q.open} ELSE {'done': acc.done, 'open': acc.open || chr(10) || q.open} END) AS f FROM s),
p AS (SELECT doc_id, list_append(f.done, f.open) AS p FROM f) SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM p"""),
    "generic_flag_quality": (generic_flag_quality, """WITH f AS (SELECT lang, coalesce((contains(lower(text), 'the of') OR contains(lower(text), 'in the') OR contains(lower(text), 'die der')) AND NOT contains(lower(text), 'and the'), false) AS p, coalesce(toxic = 1, false) AS g FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn FROM f GROUP BY 1)
SELECT *, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall FROM c"""),
    "missed_utility": (missed_utility, "WITH RECURSIVE " + _STATUS + """, p AS (SELECT DISTINCT query_id, doc_id FROM rows),
a AS (SELECT CASE WHEN f = 'none' THEN 'accepted' ELSE 'abstained' END AS status, p.doc_id IS NOT NULL AS inside, dec.query_id % 5 = 0 OR p.doc_id IS NOT NULL AS ok FROM dec LEFT JOIN p ON p.query_id = dec.query_id AND p.doc_id = dec.query_id % 3),
g AS (SELECT status, count(*) AS n, count(*) AS pools, count(*) FILTER (inside) AS gold_in_pool, count(*) FILTER (ok) AS k FROM a GROUP BY 1),""" + exact_interval("g", "status, pools, gold_in_pool") + " SELECT status, n, pools, gold_in_pool, k AS available, n - k AS nothing, round(k / n, 6) AS rate, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci"),
    "rubric_dimensions": (rubric_dimensions, " UNION ALL ".join(_dimensions(how, fold) for how, fold in (("mean", "list_avg"), ("min", "list_min"), ("max", "list_max")))),
    "headline_by_lang": (headline_by_lang, """WITH r AS (SELECT lang, unnest(['quality', 'toxic', 'length']) AS dim, unnest([CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE), n_chars / 1000]) AS x FROM documents JOIN labels USING (doc_id)),
m AS (SELECT lang, dim, count(*) AS n, avg(x) AS x FROM r GROUP BY 1, 2) SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(avg(x), 6) AS overall, string_agg(dim || '=' || printf('%.3f', round(x, 3)), ';' ORDER BY dim) AS per_dim FROM m GROUP BY 1"""),
    "coverage_merged": (coverage_merged, "WITH " + BM25 + "," + _CHUNKS + """,
cat AS (SELECT doc_id, string_agg(passage_text, ' ' ORDER BY i) AS t FROM chunks GROUP BY 1), r AS (SELECT query_id, bm.doc_id, t FROM bm LEFT JOIN cat ON cat.doc_id = bm.doc_id WHERE rank <= 100)
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS judged_docs, count(*) FILTER (t IS NULL) AS missing, count(*) FILTER (coalesce(t, '') = '') AS empty, round(sum(coalesce(length(t), 0)) / count(*), 6) AS mean_chars FROM r"""),
    "case_wide": (case_wide, """WITH f AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS fl FROM lineitem GROUP BY 1)
SELECT o_orderkey AS case_id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS selected, CASE WHEN o_orderkey % 5 <> 0 AND fl IS NOT NULL THEN o_orderpriority ELSE '' END AS decision, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END AS purpose, '' AS risks,
  CASE WHEN o_orderkey % 5 <> 0 THEN coalesce(array_to_string(fl, ' ; '), '') ELSE '' END AS missing, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(array_to_string(list_transform(fl, lambda x: x || '?'), ' ; '), '') ELSE '' END AS asked FROM orders LEFT JOIN f ON l_orderkey = o_orderkey"""),
    "summary_rebuilt": (summary_rebuilt, """SELECT o_orderkey, CASE WHEN s = '' THEN 'Not stated.' ELSE s END AS summary FROM (SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey % 3 <> 0 THEN 'Status: ' || o_orderstatus END, CASE WHEN o_orderkey % 5 <> 0 THEN 'Urgency: ' || o_orderpriority END, CASE WHEN o_orderkey % 4 = 0 THEN 'What is still unclear: ' || o_orderpriority END) AS s FROM orders)"""),
    "truth_values": (truth_values, "SELECT event_type, event_id % 8 IN (0, 1, 4, 5) AS yes, count(*) AS n FROM events GROUP BY 1, 2"),
    "slug_join": (slug_join, "SELECT p_type || '/' || p_brand AS name, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1"),
    "clamped": (clamped, "WITH c AS (SELECT l_returnflag, greatest(0, least(1, l_quantity / 30 - 0.2)) AS x FROM lineitem) SELECT l_returnflag, count(*) FILTER (x = 0) AS low, count(*) FILTER (x = 1) AS high, round(avg(x), 6) AS mean FROM c GROUP BY 1"),
    "alternating_draw": (alternating_draw, "WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY " + _HASH("o_orderkey") + ", o_orderkey) AS turn FROM orders) SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY turn, o_orderstatus) AS place FROM r QUALIFY place <= 50"),
    "interval_cells": (interval_cells, "SELECT o_orderpriority, printf('%.4f', round(avg(o_totalprice), 4)) || ' [' || printf('%.4f', round(min(o_totalprice), 4)) || ',' || printf('%.4f', round(max(o_totalprice), 4)) || ']' AS cell FROM orders GROUP BY 1"),
    "pattern_flags": (pattern_flags, r"SELECT source, coalesce(regexp_matches(text, '[0-9]{4}-[0-9]{2}') OR regexp_matches(text, '(licen[cs]e|LICEN[CS]E)') OR regexp_matches(text, '@[a-z]+\.'), false) AS hit, count(*) AS n FROM documents GROUP BY 1, 2"),
    "first_texts": (first_texts, "SELECT coalesce(CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END, '') AS said, count(*) AS n FROM orders GROUP BY 1"),
    "topic_areas": (topic_areas, "SELECT CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'Other' END AS area, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1"),
}
