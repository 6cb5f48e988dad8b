"""Which words hold which tokens as substrings: blocks of the tokens' rarest runs of characters, then verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs_of(c: Column, n: int) -> Column:
    """The distinct runs of n characters, overlapping, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def held_tokens(words: DataFrame, tokens: DataFrame, n: int = 5) -> DataFrame:
    """(word, token) for every distinct word that holds a token of n characters or more.

    A word that holds a token has all its runs of n characters, so the one that fewest
    words have is enough to meet: each token looks under one run, and tokens with a run
    that no word has are dropped before.  `words(word)` and `tokens(token)` are distinct.
    """
    grams = words.where(F.length("word") >= n).select("word", F.explode(runs_of(F.col("word"), n)).alias("run"))
    often = grams.groupBy("run").agg(F.count("*").alias("n"))
    own = tokens.where(F.length("token") >= n).select("token", F.explode(runs_of(F.col("token"), n)).alias("run"))
    rarest = own.join(often, "run", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("run"))).alias("r"))
    rarest = rarest.where("r.n > 0").select("token", "r.run")
    return grams.join(rarest, "run").where(F.contains("word", F.col("token"))).select("word", "token")
