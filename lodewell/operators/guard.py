"""Leak detectors, citation checks, fallbacks, lists and questions rebuilt from structured answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import with_interval
from ..functions.text import capitalised, distinct_folded, identifiers, stripped_words
from .substrings import held_tokens


def narrow_leaks(text: Column, own: Column, pattern: str, keep_case: bool = False, without_spaces: bool = False) -> Column:
    """Number of distinct identifiers in the text besides one's own."""
    mine = own if keep_case else F.upper(own)
    return F.size(F.array_except(identifiers(text, pattern, keep_case, without_spaces), F.array(mine))).cast("long")


def distinctive_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", cap: int | None = None, least: int = 6, stop: Sequence[str] = (), of: DataFrame | None = None) -> DataFrame:
    """(key, tokens): words that only this document's text has, sorted; the first `cap` if given.

    A word whose least and greatest key are one is in one document; both are combined
    before the shuffle, so a frequent word costs a row a task.  `of(key)` names the
    documents that are asked for; words are still counted over all.
    """
    words = docs.select(key, F.explode(stripped_words(F.col(text), least, stop)).alias("w"))
    once = words.groupBy("w").agg(F.min(key).alias(key), F.max(key).alias("_last")).where(F.col(key) == F.col("_last")).select(key, "w")
    if of is not None:
        once = once.join(of.select(key).distinct(), key, "left_semi")
    tokens = F.array_sort(F.collect_set("w"))
    return once.groupBy(key).agg((tokens if cap is None else F.slice(tokens, 1, cap)).alias("tokens"))


def wide_leaks(answers: DataFrame, vocabulary: DataFrame, case: str, own: str = "own", text: str = "answer", pool: str = "pool", least: int = 5) -> DataFrame:
    """(case, wide): whether the answer holds, as a substring, a distinctive token of another document of its pool.

    The pool's ids are exploded and joined with the vocabulary, so an answer meets only its
    own pool's tokens.
    """
    other = answers.select(case, text, own, F.explode(pool).alias("_doc")).where(F.col("_doc") != F.col(own))
    found = other.join(vocabulary.withColumnsRenamed({"doc_id": "_doc"}), "_doc")
    hit = F.exists("tokens", lambda t: (F.length(t) >= least) & F.contains(F.lower(F.col(text)), t))
    flags = found.groupBy(case).agg(F.max(hit.cast("int")).alias("wide"))
    return answers.select(case).distinct().join(flags, case, "left").select(case, F.coalesce("wide", F.lit(0)).cast("long").alias("wide"))


def citation_errors(claim: Column, supports: Column, allowed: Column, fallback: str, keywords: Sequence[str] = ()) -> Column:
    """Messages of what is wrong with a claim and its supports, in a fixed order."""
    empty = claim.isNull() | (F.trim(claim) == "")
    stated = ~empty & (claim != fallback)
    none = F.coalesce(F.size(supports), F.lit(0)) <= 0
    rules = [
        (empty, "missing claim"),
        (stated & none, "no supports"),
        (stated & ~none & (F.size(F.array_except(supports, allowed)) > 0), "unknown support"),
    ]
    if keywords:
        low = F.lower(claim)
        has = F.lit(False)
        for k in keywords:
            has = has | F.contains(low, F.lit(k))
        rules.append((stated & ~has, "no field keyword"))
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules]))


def corrected(claim: Column, supports: Column, allowed: Column, fallback: str, keywords: Sequence[str] = ()) -> Column:
    """struct(claim, supports, change): known supports kept; the first rule broken turns the claim into the fallback."""
    kept = F.array_intersect(F.coalesce(supports, F.array().cast("array<int>")), allowed)
    errors = citation_errors(claim, kept, allowed, fallback, keywords)
    bad = F.size(errors) > 0
    change = F.when(bad, errors[0]).when(F.size(kept) < F.size(supports), F.lit("dropped supports")).otherwise(F.lit(""))
    none = F.array().cast("array<int>")
    return F.struct(F.when(bad, F.lit(fallback)).otherwise(claim).alias("claim"), F.when(bad, none).otherwise(kept).alias("supports"), change.alias("change"))


def hard_gate(claim: Column, supports: Column, allowed: Column, fallback: str) -> Column:
    """The claim, or the fallback if any support is outside the allowed ones."""
    return F.when(F.size(F.array_except(supports, allowed)) > 0, F.lit(fallback)).otherwise(claim)


def supports_in(supports: Column, n: Column | int) -> Column:
    """Whether there are supports and all are within 1..n."""
    top = F.lit(n) if isinstance(n, int) else n
    return (F.size(supports) > 0) & F.forall(supports, lambda x: x.between(F.lit(1), top))


def unclear_items(missing: Column, unresolved: Column) -> Column:
    """Both lists, trimmed, without final periods, capitalised, blank and repeated entries left out."""
    both = F.transform(F.concat(F.coalesce(missing, F.array().cast("array<string>")), F.coalesce(unresolved, F.array().cast("array<string>"))), lambda x: F.regexp_replace(F.trim(x), r"\.+$", ""))
    return distinct_folded(F.transform(F.filter(both, lambda x: x != ""), lambda x: capitalised(x)))


def summary(fields: Mapping[str, Column], fallback: str) -> Column:
    """Stated fields joined by spaces."""
    return F.concat_ws(" ", *[F.when(F.coalesce(c, F.lit("")) != fallback, c) for c in fields.values()])


def question(item: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """A question by the first rule whose key word the item holds; `%s` is the item without final periods, lower-cased."""
    low = F.lower(F.regexp_replace(item, r"\.+$", ""))
    out = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.format_string(t, low) if "%s" in t else F.lit(t)) for k, t in rules], F.format_string(default, low) if "%s" in default else F.lit(default))
    return out


def field_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, before, after) of fields that changed; a missing row counts as null."""
    long = lambda df, name: df.unpivot([F.col(key)], [F.col(f) for f in fields], "field", name)
    both = long(before, "before").join(long(after, "after"), [key, "field"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def other_if_unknown(c: Column, names: Sequence[str], other: str = "Other") -> Column:
    return F.when(c.isin(*names), c).otherwise(F.lit(other))


def leak_flags(answers: DataFrame, vocabulary: DataFrame, case: str, narrow: Column, own: str = "own", text: str = "answer", least: int = 5) -> DataFrame:
    """(case, narrow, wide) with all documents as pool: wide is narrow, or some other document's token stands in the answer.

    Tokens are found as substrings of the lower-cased answer, inside longer words too;
    they have no white space, so each lies within a word.  The answers' distinct words
    meet the tokens by `held_tokens`; of each word only the least and greatest document
    of its tokens is kept, which tells whether one of them is another's than one's own.
    """
    token = vocabulary.select(F.col("doc_id").alias("_doc"), F.explode("tokens").alias("token"))
    words = answers.select(case, own, F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("word")).where(F.length("word") >= least)
    held = held_tokens(words.select("word").distinct(), token.select("token").distinct(), least)
    of = held.join(token, "token").groupBy("word").agg(F.min("_doc").alias("_lo"), F.max("_doc").alias("_hi"))
    foreign = words.join(of, "word").where((F.col("_lo") != F.col(own)) | (F.col("_hi") != F.col(own))).select(case).distinct().withColumn("_hit", F.lit(True))
    rows = answers.select(case, (narrow > 0).alias("narrow")).join(foreign, case, "left")
    return rows.select(case, "narrow", (F.col("narrow") | F.coalesce("_hit", F.lit(False))).alias("wide"))


def leak_summary(flags: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group: n, and for each flag the rate with the exact 95 % interval, to four places."""
    out = flags.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"_{c}") for c in columns])
    for c in columns:
        out = with_interval(out, f"_{c}", "n").withColumns({f"{c}_rate": F.round(F.col(f"_{c}") / F.col("n"), 4), f"{c}_lo": F.round("lo", 4), f"{c}_hi": F.round("hi", 4)}).drop("lo", "hi", f"_{c}")
    return out


def taxonomy(label: Column, leak: Column, allowed: Sequence[str], default: str = "T1") -> Column:
    """The label where it is an allowed one; `none` without a leak, else the default."""
    known = F.upper(F.trim(label))
    return F.when(F.coalesce(leak, F.lit(0)) == 0, F.lit("none")).when(known.isin(*allowed), known).otherwise(F.lit(default))


def consensus(a: Column, b: Column) -> Column:
    """struct(either, both, agree) of two judges' flags of 0 and 1; with one judge missing, the other decides both, and `agree` is null."""
    return F.struct(F.greatest(a, b).alias("either"), F.least(a, b).alias("both"), (a == b).cast("int").alias("agree"))


def abstention_record(case: Column, reason: Column, fallback: str, fields: Sequence[str]) -> Column:
    """The record of a case that is not answered: every field the fallback, no supports, the reason."""
    return F.struct(case.alias("case_id"), F.lit("abstained").alias("status"), reason.alias("reason"), *[F.lit(fallback).alias(f) for f in fields], F.array().cast("array<int>").alias("supports"))


def redaction_audit(claims: DataFrame, dropped: Column, flag: str) -> DataFrame:
    """Claims by flag: how many, how many dropped, the share."""
    out = claims.groupBy(flag).agg(F.count("*").alias("claims"), F.count_if(dropped).alias("dropped"))
    return out.withColumn("rate", F.round(F.col("dropped") / F.col("claims"), 6))


def uniform(bundle: Column, variants: Sequence[str], field: str) -> Column:
    """An array of struct(variant, value) out of a struct of variants; variants without the record are left out."""
    return F.filter(F.array(*[F.struct(F.lit(v).alias("variant"), bundle[v][field].alias("value")) for v in variants]), lambda x: x["value"].isNotNull())
