"""JSON out of model text: tolerant extraction, validation, canonical values."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def outer_object(c: Column) -> Column:
    """From the first brace to the last; '' if there are none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)


def unfenced(c: Column) -> Column:
    """Without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


#: What matters for nesting: whole strings (an open one runs to the end) and braces.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z|\\\Z)|[{}]', re.DOTALL)
_STEP = {"{": 1, "}": -1}


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first complete object, braces inside strings not counted; null if none closes.

    Nesting can't be told by a regular expression, hence Arrow batches: an object ends at
    the first token where the running sum of its braces is back at zero.
    """

    def found(t: str | None) -> str | None:
        rest = (t or "").partition("{")
        text = rest[1] + rest[2]
        tokens = list(_TOKEN.finditer(text))
        depth = accumulate(_STEP.get(m.group(), 0) for m in tokens)
        return next((text[: m.end()] for m, d in zip(tokens, depth, strict=True) if d == 0), None)

    return texts.map(found)


def parsed(c: Column, schema: str) -> Column:
    """The outer object by a schema; null where it isn't one JSON value (text behind the first would be passed over otherwise)."""
    text = outer_object(unfenced(c))
    return F.when(first_object(text) == text, F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def score_in(c: Column, low: int = 1, high: int = 5) -> Column:
    """A whole number within bounds, else null."""
    x = c.cast("string").try_cast("double")
    return F.when((x == F.floor(x)) & x.between(low, high), x.cast("int"))


def flag01(c: Column) -> Column:
    """1 or 0; anything else is 0."""
    return F.when(F.coalesce(c.cast("string").try_cast("int"), F.lit(0)) == 1, 1).otherwise(0)


def canonical_choice(c: Column, choices: Sequence[str], default: str) -> Column:
    """Trimmed, lower-cased, spaces to _: a choice as it is; else the first choice, in order, that it contains; else the default."""
    x = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))
    inside = F.coalesce(*[F.when(F.contains(x, F.lit(k)), F.lit(k)) for k in choices])
    return F.when(x.isin(*choices), x).otherwise(F.coalesce(inside, F.lit(default)))
