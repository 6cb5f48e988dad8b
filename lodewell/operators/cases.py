"""Cases put together for judges and readers: other candidates with passages, prompts, wide rows, coverage and headlines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import with_interval
from ..functions.text import distinct_heads, first_text, list_cell, recode, shorten
from .evidence import first_rows

# The place of each section when a document's passages are looked up; others come last.
SECTION_PLACES = {"eligibility": 0, "brief_summary": 1, "summary": 1, "detailed_description": 2, "primary_outcome": 3, "secondary_outcome": 4}
LAST_PLACE = 9


def looked_up(docs: DataFrame, passages: DataFrame, k: int, key: str = "doc_id", text: str = "passage_text", most: int = 700) -> DataFrame:
    """(key, passages): each asked document's first k passages by section, then passage id, shortened; documents without any are left out.

    Repeated documents are asked for once; the join comes before the window, so only
    passages of asked documents are ordered.
    """
    place = F.coalesce(recode(F.col("section"), SECTION_PLACES), F.lit(LAST_PLACE))
    asked = passages.join(docs.select(key).distinct(), key).select(key, "passage_id", place.alias("_place"), shorten(F.trim(F.coalesce(F.col(text), F.lit(""))), most, "…").alias("_text"))
    firsts = first_rows(asked, [key], [F.asc("_place"), F.asc("passage_id")], k)
    rows = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "_text"))).alias("_p"))
    return rows.select(key, F.transform("_p", lambda x: x["_text"]).alias("passages"))


def candidates(selected: DataFrame, scored: DataFrame, run: DataFrame, passages: DataFrame, case: str = "query_id", key: str = "doc_id", groups: int = 4, each: int = 2, most: int = 700) -> DataFrame:
    """(case, position, key, route, passages): the first few documents of each case that weren't selected, with passages.

    `selected` is (case, selected); ids are compared without case, a null selection
    excludes nothing.  Where `scored` (case, key, passage_id, score, passage_text) has rows
    of a case, its documents come by their best row's score (ties: smaller key, then
    passage id); that row's passage is followed by those looked up, and passages alike in
    80 characters count once.  All other cases take the run (case, key, rank) instead, and
    documents without passages fall out there after the first few are chosen.  A case whose scored rows are all the
    selected document's has no candidates: the run does not stand in.
    """
    other = lambda df: df.join(selected.select(case, F.upper(F.col("selected").cast("string")).alias("_sel")), case).where(F.coalesce(F.upper(F.col(key).cast("string")) != F.col("_sel"), F.lit(True)))
    best = first_rows(other(scored), [case, key], [F.desc("score"), F.asc("passage_id")], 1).drop("position")
    one = first_rows(best, [case], [F.desc("score"), F.asc(key)], groups)
    two = first_rows(other(run.join(scored.select(case).distinct(), case, "left_anti")), [case], [F.asc("rank"), F.asc(key)], groups)
    own = shorten(F.trim(F.coalesce("passage_text", F.lit(""))), most, "…")
    both = one.select(case, key, "position", F.lit("scored").alias("route"), own.alias("_own")).unionByName(two.select(case, key, "position", F.lit("run").alias("route"), F.lit(None).cast("string").alias("_own")))
    rows = both.join(looked_up(both, passages, each, key, most=most), key, "left")
    found = F.coalesce("passages", F.array().cast("array<string>"))
    told = F.when(F.col("_own").isNull(), found).otherwise(distinct_heads(F.concat(F.array("_own"), F.slice(found, 1, 1)), 80, each))
    return rows.select(case, "position", key, "route", told.alias("passages")).where((F.col("route") == "scored") | (F.size("passages") > 0))


def blocks(found: DataFrame, head: str, case: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(case, n_candidates, blocks): each case's candidates as blocks under `head`, a line a passage; a case has a few, by `candidates`."""
    block = F.concat(F.lit(f"{head} "), F.col(key).cast("string"), F.lit("\n"), F.array_join(F.transform("passages", lambda p: F.concat(F.lit("- "), p, F.lit("\n"))), ""))
    rows = found.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("_b"))
    return rows.select(case, F.size("_b").cast("long").alias("n_candidates"), F.array_join(F.transform("_b", lambda x: x["b"]), "\n").alias("blocks"))


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its value; null is empty.  Braces in values stay as they are."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def prompts(cases: DataFrame, found: DataFrame, template: str, head: str, nothing: str, case: str = "query_id", key: str = "doc_id", most: int = 5000) -> DataFrame:
    """(case, n_candidates, prompt) of every case: `template` with {selected}, {own}, {n}, {candidates} and {answer}.

    `cases` is (case, selected, own, answer).  Empty texts read "(empty)", answers are
    shortened, `nothing` stands for no candidates.
    """
    rows = cases.join(blocks(found, head, case, key), case, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long")))
    said = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(empty)"))
    prompt = filled(template, selected=F.col("selected"), own=said(F.col("own")), n=F.col("n_candidates"), candidates=F.coalesce("blocks", F.lit(nothing)), answer=shorten(said(F.col("answer")), most, "…"))
    return rows.select(case, "n_candidates", prompt.alias("prompt"))


def retold(question: Column, tail: str, other: Column) -> Column:
    """The question up to its first `tail`, trimmed, and another tail; one without it keeps all."""
    return F.concat(F.trim(F.split_part(question, F.lit(tail), F.lit(1))), F.lit(" "), other)


def wide_record(cases: DataFrame, parts: Mapping[str, DataFrame], plain: Mapping[str, str], texts: Mapping[str, str], lists: Mapping[str, str], case: str = "case_id") -> DataFrame:
    """One wide row a case out of one JSON document of each part.

    `parts` are (case, body) with the parsed body; `plain` names columns by their path
    (`context.status`), `texts` by the path of a struct with a `text`, `lists` by that of an
    array, whose entries are joined by " ; ".  What is missing is ''.  A case without a
    part keeps its row.
    """
    rows = cases
    for name, part in parts.items():
        rows = rows.join(part.select(case, F.col("body").alias(f"_{name}")), case, "left")
    at = lambda path: F.col(f"_{path}")
    out = [first_text(at(p).cast("string")).alias(c) for c, p in plain.items()]
    out += [first_text(at(f"{p}.text")).alias(c) for c, p in texts.items()]
    out += [F.coalesce(list_cell(at(p)), F.lit("")).alias(c) for c, p in lists.items()]
    return rows.select(*cases.columns, *out)


def rebuilt_summary(fields: Mapping[str, Column], unclear: Column, fallback: str, label: str = "What is still unclear") -> Column:
    """`name: text` of each stated field, then the unclear points; the fallback where nothing is stated (null counts as the fallback)."""
    stated = [F.when(F.coalesce(F.trim(c), F.lit(fallback)) != fallback, F.concat(F.lit(f"{name}: "), F.trim(c))) for name, c in fields.items()]
    points = F.filter(F.transform(F.coalesce(unclear, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != fallback.lower()))
    last = F.when(F.size(points) > 0, F.concat(F.lit(f"{label}: "), F.array_join(points, "; ")))
    return F.coalesce(F.nullif(F.concat_ws(" ", *stated, last), F.lit("")), F.lit(fallback))


def flag_quality(rows: DataFrame, predicted: Column, gold: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, the four counts, precision and recall of a flag (null: not set); a share of nothing is 0."""
    p, g = F.coalesce(predicted, F.lit(False)), F.coalesce(gold, F.lit(False))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))
    share = lambda other: F.round(F.col("tp") / F.greatest(F.col("tp") + F.col(other), F.lit(1)), 6)
    return out.withColumns({"precision": share("fp"), "recall": share("fn")})


def missed_utility(cases: DataFrame, pool: DataFrame, case: str = "query_id", regime: str = "status", gold: str = "gold", flag: str = "relevant", member: str = "doc_id") -> DataFrame:
    """Per regime: cases, pools found, gold in the pool, something relevant available (that, or the flag), nothing, the share with its exact interval."""
    hits = pool.groupBy(case, F.col(member).alias(gold)).agg(F.lit(True).alias("_in"))
    pools = pool.select(case).distinct().withColumn("_pool", F.lit(True))
    rows = cases.join(hits, [case, gold], "left").join(pools, case, "left").withColumns({"_in": F.coalesce("_in", F.lit(False)), "_pool": F.coalesce("_pool", F.lit(False))})
    rows = rows.withColumn("_ok", F.col("_in") | F.coalesce(F.col(flag), F.lit(False)))
    out = rows.groupBy(regime).agg(F.count("*").alias("n"), F.count_if("_pool").alias("pools"), F.count_if("_in").alias("gold_in_pool"), F.count_if("_ok").alias("available"), F.count_if(~F.col("_ok")).alias("nothing"))
    return with_interval(out.withColumn("rate", F.round(F.col("available") / F.col("n"), 6)), "available", "n")


def coverage(run: DataFrame, texts: DataFrame, judged: DataFrame, case: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row on a run after its texts are merged: rows, cases, documents, those judged, rows without a text or with an empty one, mean length.

    A missing text counts as empty too, and as of length 0.  Documents are counted once,
    judged or not, by one grouping; nothing is broadcast by hand.
    """
    rows = run.select(case, key).join(texts.select(key, F.col(text).alias("_t")), key, "left")
    length = F.coalesce(F.length("_t"), F.lit(0))
    per = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(F.col("_t").isNull()).alias("_null"), F.count_if(length == 0).alias("_none"), F.sum(length).alias("_chars"))
    known = judged.select(key).distinct().withColumn("_j", F.lit(1))
    cols = [F.sum("_n").alias("n_rows"), F.count("*").alias("n_docs"), F.count("_j").alias("judged_docs"), F.sum("_null").alias("missing"), F.sum("_none").alias("empty"), F.round(F.sum("_chars") / F.sum("_n"), 6).alias("mean_chars")]
    return per.join(known, key, "left").agg(*cols)


def headline(rows: DataFrame, by: str, dimension: str, value: str, digits: int = 3) -> DataFrame:
    """(by, n, overall, per_dim): the mean of the dimensions' means, and those means as a map in order of name."""
    means = rows.groupBy(by, dimension).agg(F.count("*").alias("_n"), F.avg(value).alias("_mean"))
    out = means.groupBy(by).agg(F.sum("_n").alias("n"), F.round(F.avg("_mean"), 6).alias("overall"), F.array_sort(F.collect_list(F.struct(dimension, F.round("_mean", digits).alias("mean")))).alias("_d"))
    return out.select(by, "n", "overall", F.map_from_entries("_d").alias("per_dim"))


def ranked_in_turn(rows: DataFrame, stratum: str, order: Sequence[Column], take: int) -> DataFrame:
    """The first `take` rows in turn from the strata: all firsts by stratum, then all seconds; `place` from 1.

    No stratum gives more than `take` rows, so what is ordered as a whole is small.
    """
    turns = first_rows(rows, [stratum], order, take).orderBy("position", stratum).limit(take)
    return turns.withColumn("place", F.row_number().over(Window.orderBy("position", stratum)))
