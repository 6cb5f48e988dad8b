"""Host-level quality rules: failures of each rule by host, rates shrunk by an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import binary_column, sliced, written

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_START = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def statistics_of(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """The five statistics of each text of one Arrow column (null: none of anything)."""
    data, offs = binary_column(column)
    n = len(offs) - 1
    s, e, doc = tv.words(data, offs)
    spans = tv.Spans(data)
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = tv.per_document(_START[data] & ~tv.SEPARATOR[data], offs)
    out["n_symbols"] = tv.per_document(_SYMBOL[data], offs)
    # equal lines: any after the first of its kind in its document, if it has a word
    ls, le, ld = tv.lines(data, offs)
    solid = np.concatenate([[0], np.cumsum(~tv.SEPARATOR[data])])
    real = solid[le] > solid[ls]
    ls, le, ld = ls[real], le[real], ld[real]
    _, first = np.unique(spans.hash(ls, le) ^ tv.mix(ld.astype(np.uint64)), return_index=True)
    out["n_dup_lines"] = np.bincount(ld, minlength=n) - np.bincount(ld[first], minlength=n)
    # words inside a window that its document holds at least twice
    at, key = tv.windows(spans.hash(s, e), doc, window)
    key ^= tv.mix(doc[at].astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key) + 1, bool)
    twice[1:-1] = same
    repeated = at[order[twice[:-1] | twice[1:]]] if len(key) else at
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, np.minimum(repeated + window, len(s)), -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def document_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns and the statistics of each document, one pass, nothing shuffled."""
    narrow = docs.select(*keep, F.col(text).alias("__lw_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", " + STATISTICS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "__lw_text"):
            found = statistics_of(b.column("__lw_text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v) for v in found.values())], names=[*keep, *found])

    return narrow.mapInArrow(run, schema)


#: The rules a document can fail, in the order of their bits; the first two are the base.
RULES = {
    "few": "n_words < 20",
    "repetition": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "20 * n_dup_lines > n_words",
    "lengths": "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words",
}
BASE = 2
#: A host whose shrunken rate of base failures exceeds REJECT takes all its documents along; where a rule's
#: shrunken rate exceeds COMMON, failing it is a habit of the host, and documents of the host that fail it go.
REJECT, COMMON = 0.9, 0.02


def _fails(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The rules that each document fails, as bits."""
    w, chars = stats["n_words"], stats["word_chars"]
    rules = (w < 20, 100 * stats["n_repeat_words"] > 30 * w, 10 * stats["n_symbols"] > w, 20 * stats["n_dup_lines"] > w, (2 * chars < 5 * w) | (chars > 12 * w))
    return sum(r.astype(np.int32) << i for i, r in enumerate(rules))


def with_fails(stats: DataFrame) -> DataFrame:
    """`stats` with `fails`, the rules that a document fails as bits, and base_failed."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
    return stats.withColumn("fails", F.expr(bits)).withColumn("base_failed", F.expr(f"fails & {(1 << BASE) - 1} > 0"))


def host_verdicts(rows: DataFrame, host: str, reject: float = REJECT, common: float = COMMON) -> DataFrame:
    """One row per host of rows(host, fails): n_docs, host_failed, `habits` (rules as bits) and the shrunken rates.

    For each rule (and the base as a whole) a beta prior is fitted to all hosts by the
    method of moments: mean m and variance v of host rates, less the binomial variance
    expected at their sizes, give a strength s = m(1-m)/v - 1 held within [1, 1000].  A
    host's rate is its posterior mean (failures + s m) / (documents + s).  A null host is
    no host: such documents are judged by the base rules alone.
    """
    named = [*RULES, "base"]
    hit = {name: F.col("fails").bitwiseAND(F.lit(1 << i)) > 0 for i, name in enumerate(RULES)} | {"base": F.col("fails").bitwiseAND(F.lit((1 << BASE) - 1)) > 0}
    hosts = rows.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), *(F.sum(hit[x].cast("long")).alias(f"n_{x}") for x in named))
    hosts = written(hosts, "hosts")
    fit = hosts.agg(
        F.avg(1 / F.col("n_docs")).alias("inv"),
        *((F.sum(f"n_{x}") / F.sum("n_docs")).alias(f"m_{x}") for x in named),
        *(F.coalesce(F.var_samp(F.col(f"n_{x}") / F.col("n_docs")), F.lit(0.0)).alias(f"v_{x}") for x in named),
    ).first()
    for x in named:
        m = float(fit[f"m_{x}"] or 0.0)
        v = max(1e-9, float(fit[f"v_{x}"] or 0.0) - m * (1 - m) * float(fit["inv"] or 0.0))
        strength = min(1000.0, max(1.0, m * (1 - m) / v - 1))
        hosts = hosts.withColumn(f"rate_{x}", (F.col(f"n_{x}") + F.lit(strength * m)) / (F.col("n_docs") + F.lit(strength)))
    habits = sum((F.when(F.col(f"rate_{x}") > common, 1 << i).otherwise(0) for i, x in enumerate(RULES)), F.lit(0))
    return hosts.withColumn("host_failed", F.col("rate_base") > reject).withColumn("habits", habits)


#: A table of at most this many hosts may be broadcast (names of hosts: a few MB).
BROADCAST_HOSTS = 20_000
#: Parts that each host's documents are dealt over in a shuffled join.
SALTS = 64


def join_verdicts(rows: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """`rows` with `__lw_failed`, whether their host failed, and `__lw_habits`.  Only hosts with a verdict are joined.

    Their number is counted first: up to `BROADCAST_HOSTS` they are broadcast, beyond it
    they are shuffled with every host's rows dealt over `SALTS` parts, as one host may
    hold a third of all rows.
    """
    bad = verdicts.where("host_failed OR habits > 0").select(F.col(host).alias("__lw_host"), F.col("host_failed").alias("__lw_failed"), F.col("habits").alias("__lw_habits"))
    same = F.col(host) == F.col("__lw_host")
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(bad), same, "left")
    else:
        bad = bad.withColumn("__lw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("__lw_s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = salted.join(bad, same & (F.col("__lw_s") == F.col("__lw_salt")), "left").drop("__lw_s", "__lw_salt")
    return joined.withColumn("__lw_failed", F.coalesce("__lw_failed", F.lit(False))).withColumn("__lw_habits", F.coalesce("__lw_habits", F.lit(0))).drop("__lw_host")


def _kept(fails: str) -> str:
    return f"{fails} & {(1 << BASE) - 1} = 0 AND NOT __lw_failed AND {fails} & __lw_habits = 0"


def judge(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", reject: float = REJECT, common: float = COMMON) -> DataFrame:
    """One row per document: key, statistics, fails, base_failed, host_failed, kept.

    A document goes if it fails a base rule, if its host failed, or if it fails a rule
    that its host fails as a habit.  Null or empty text has zero words and so fails the
    base; very long texts are read whole; repeated rows are judged one by one; an empty
    table gives no rows; other columns are not read.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("__source"), F.col(text).alias("text"))
    stats = written(with_fails(document_statistics(narrow, ["doc_id", "__source"])), "stats")
    judged = join_verdicts(stats, host_verdicts(stats, "__source", reject, common), "__source")
    return judged.withColumn("kept", F.expr(_kept("fails"))).withColumnRenamed("__lw_failed", "host_failed").drop("__source", "__lw_habits")


def keep_good(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", reject: float = REJECT, common: float = COMMON) -> DataFrame:
    """The documents that `judge` keeps, with their own columns.

    Texts are read once: every document is written beside the rules it fails, hosts are
    aggregated from these bits, and their verdicts are joined; no text is shuffled.
    Nulls, long texts, repeats and empty tables as in `judge`.
    """
    columns = docs.columns

    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at[text]):
            fails = _fails(statistics_of(b.column(at[text])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fails, pa.int32())], names=[*b.schema.names, "fails"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema) + ", fails int"
    rows = written(named.mapInArrow(flagged, schema), "flagged")
    good = join_verdicts(rows.where(F.expr(f"fails & {(1 << BASE) - 1} = 0")), host_verdicts(rows, at[host], reject, common), at[host]).where(_kept("fails"))
    return good.select(*[F.col(at[c]).alias(c) for c in columns])
