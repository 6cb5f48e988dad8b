"""Text functions as Column expressions; all but `packed_lines` run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def squash(c: Column) -> Column:
    """White space (Unicode too) to single spaces, ends trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def terms(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(c: Column) -> Column:
    """Pieces between white space that follows . ? or !"""
    return F.split(c, r"(?<=[.?!])\s+")


def claims(c: Column) -> Column:
    """Sentences cut only before a capital or a digit, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda x: F.trim(x)), lambda x: x != "")


def pack_greedily(pieces: Column, most: int, least: int = 0, joint: str = " ") -> Column:
    """Neighbouring pieces joined while the result has at most `most` characters.

    A piece that is longer by itself ends what is open and is cut into trimmed blocks of
    `most`, which stand alone: the next piece starts afresh.  Results under `least`
    characters are dropped.  One fold over the array, so one row stays one row.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(joint), p))
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.trim(F.substring(p, i * most + 1, F.lit(most))))
        return (
            F.when(F.length(joined) <= most, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .when(F.length(p) <= most, F.struct(closed.alias("done"), p.alias("open")))
            .otherwise(F.struct(F.concat(closed, F.filter(blocks, lambda x: x != "")).alias("done"), F.lit("").alias("open")))
        )

    packed = F.aggregate(F.filter(pieces, lambda p: p != ""), start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return F.filter(packed, lambda x: F.length(x) >= least)


@F.pandas_udf(ArrayType(StringType()))
def _packed(pieces: pd.Series, most: pd.Series) -> pd.Series:
    def pack(row, n):
        done, parts, size = [], [], 0
        for p in () if row is None else (p.strip() for p in row if p is not None):
            if size and size + len(p) + 1 > n:
                done.append("\n".join(parts))
                parts, size = [], 0
            if p:
                size += len(p) + (1 if parts else 0)
                parts.append(p)
        return [*done, "\n".join(parts)] if parts else done or [""]

    return pd.Series([pack(row, n) for row, n in zip(pieces, most, strict=True)])


def packed_lines(pieces: Column, most: int = 1800) -> Column:
    """Trimmed pieces on lines of their own, joined while the result has at most `most` characters; longer pieces stand alone, uncut.

    Blank and null pieces add nothing; without any (or without a list) there is one empty
    text.  Linear in the pieces (an Arrow pass): a fold would copy what it has for each.
    """
    return _packed(pieces, F.lit(most))


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounded to `digits` places, halves to the even neighbour."""
    return F.bround(c, digits)


def starts_with_any(c: Column, heads: Sequence[str]) -> Column:
    """Whether the text begins with one of the heads; null counts as no."""
    found = F.lit(False)
    for h in heads:
        found = found | F.startswith(c, F.lit(h))
    return F.coalesce(found, F.lit(False))


def distinct_heads(items: Column, n: int = 80, most: int = 2) -> Column:
    """The first `most` texts that differ in their first n characters."""
    heads = F.transform(items, lambda x: F.substring(x, 1, n))
    firsts = F.filter(items, lambda x, i: F.array_position(heads, F.substring(x, 1, n)) == i.cast("long") + 1)
    return F.slice(firsts, 1, most)


def evidence_block(rank: Column, doc: Column, section: Column, text: Column) -> Column:
    """One passage under a header that names its rank, document and section (null: unknown)."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.concat(F.lit("[Passage "), F.coalesce(rank, F.lit(1)).cast("int").cast("string"), F.lit(" | doc="), blank(doc), F.lit(" | section="), F.coalesce(section, F.lit("unknown")), F.lit("]\n"))
    return F.concat(head, blank(text))


def shorten(c: Column, n: int, mark: str = "...") -> Column:
    """At most n characters, then the mark."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(mark)))


def snippet(c: Column, n: int) -> Column:
    """The first n characters on one line."""
    return F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" "))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def safe_tag(c: Column) -> Column:
    """A name usable in file names: / to __, - to _."""
    return F.replace(F.replace(c, F.lit("/"), F.lit("__")), F.lit("-"), F.lit("_"))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_")


def unslug_first(c: Column) -> Column:
    """The first __ back to /."""
    return F.regexp_replace(c, "^([^_]*)__", "$1/")


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Substring match of any phrase; null text has none."""
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(c, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.rlike(c, p)), F.lit(False))


def generic_flag(c: Column, phrases: Sequence[str], anchors: Sequence[str]) -> Column:
    """Some generic phrase and no anchoring one, as substrings of the lower-cased text."""
    low = F.lower(c)
    return contains_any(low, phrases) & ~contains_any(low, anchors)


def stripped_words(c: Column, least: int = 6, stop: Sequence[str] = ()) -> Column:
    """Lower-cased words without .,;:() at their ends, letters only, of `least` letters or more, stop words left out."""
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", ""))
    keep = F.filter(words, lambda w: F.rlike(w, F.lit(rf"^\p{{L}}{{{least},}}$")))
    return F.array_except(keep, F.array(*[F.lit(s) for s in stop])) if stop else F.array_distinct(keep)


def identifiers(c: Column, pattern: str, keep_case: bool = False, without_spaces: bool = False) -> Column:
    """Distinct identifiers in the text; upper-cased, and inner spaces dropped, as asked."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    if without_spaces:
        found = F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("")))
    return F.array_distinct(found if keep_case else F.transform(found, F.upper))


def distinct_folded(arr: Column) -> Column:
    """First of each group of entries equal but for case, order kept."""
    low = F.transform(arr, F.lower)
    return F.filter(arr, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def list_cell(arr: Column) -> Column:
    return F.concat_ws(" ; ", arr)


def cell_list(c: Column, sep: str = ",") -> Column:
    return F.transform(F.split(c, sep), lambda x: F.trim(x))


def four_decimals(x: Column) -> Column:
    return F.format_string("%.4f", x)


def first_text(*cols: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def blind_id(n: int, *parts: Column) -> Column:
    """n hex characters of the SHA-1 of the parts joined by colons."""
    return F.substring(F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, n)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def number(c: Column) -> Column:
    """A double; what isn't one is 0, as is NaN."""
    x = c.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))


def truth(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "1.0", "t", "y"), F.lit(False))


def recode(c: Column, mapping: dict) -> Column:
    """Values by a literal map; what isn't in it is null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def draw(*keys: Column) -> Column:
    """A number below 2**32 from the MD5 of the keys: the same on any cluster and in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[k.cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("long")
