"""Repeated passages: threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every string of LENGTH bytes belongs to the bin of its minimizer, the least hash of its
GRAM-byte substrings, so equal strings are in one bin.  A run of strings with one
minimizer is one row (its bytes are the run's), and equal runs are counted before
anything moves.  A bin with one distinct run is settled by its count.  The others are
indexed: a suffix array, its Burrows-Wheeler transform, and from it breadth-first
backward extension: intervals of strings of length 1, 2, 3, ... give the places where
the common prefix of neighbouring suffixes is 0, 1, 2, ..., up to LENGTH - 1.  Where
nothing was placed by then, neighbours share LENGTH bytes at least.

Shorter repeats come first: strings of PASSAGE bytes over all texts, and strings of LENGTH
bytes only in the spans that those cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import binary_column, only_these, sliced, written

LENGTH = 400
#: Bytes of a shorter repeated string, some fifty words, that marks a passage.
PASSAGE = 250
GRAM = 64
#: Bytes of runs that are indexed together; a bin beyond MOST is split by a second minimizer, and what of it
#: is still beyond has its strings hashed one by one instead.
BATCH = 1 << 20
MOST = 8 << 20

_U = np.uint64
_SEED = 7  # symbols that the first sort covers


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, _U)
    blocks[: len(x)] = x
    rows = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs_of(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM, seed: int = 0) -> dict[str, np.ndarray]:
    """Runs of strings of `length` bytes within one document that have one minimizer, by the order that `seed` gives.

    doc (row), start, strings (their number), bin, content (hash of the run's bytes), and
    whether the minimizer occurs in it twice, as it does where a string recurs in its run.
    """
    names = ("doc", "start", "strings", "bin", "content", "twice")
    n = len(data)
    if n < length:
        return dict.fromkeys(names, np.empty(0, np.int64))
    spans = tv.Spans(data)
    at = np.arange(n - gram + 1)
    grams = spans.hash(at, at + gram)
    if seed:
        grams = tv.mix(grams ^ _U(seed))
    w = length - gram + 1
    least = _slide(grams, w)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    valid = np.arange(len(least)) + length <= offs[doc + 1]
    j = np.flatnonzero(valid)
    if not len(j):
        return dict.fromkeys(names, np.empty(0, np.int64))
    v, d = least[j], doc[j]
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])]))
    first, count = j[new], np.diff(np.append(new, len(j)))
    value = v[new]
    end = first + count - 1 + length
    # where minimizers stand: a gram that is the least of some window that holds it
    reach = ~_slide(~np.concatenate([np.zeros(w - 1, _U), least, np.zeros(w - 1, _U)]), w)
    stand = np.flatnonzero(grams == reach[: len(grams)])
    order = np.lexsort((stand, grams[stand]))
    values, rank = np.unique(grams[stand[order]], return_inverse=True)
    key = (rank.astype(np.int64) << 40) + stand[order]
    mine = np.searchsorted(values, value).astype(np.int64) << 40
    hits = np.searchsorted(key, mine + end - gram, "right") - np.searchsorted(key, mine + first, "left")
    return {"doc": d[new], "start": first - offs[d[new]], "strings": count, "bin": value.view(np.int64), "content": spans.hash(first, end).view(np.int64), "twice": (hits > 1).astype(np.int64)}


def suffix_array(text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, first ranks): `text` in symbols, 0 at each of the `stop` positions, which all differ.

    Doubling from keys of _SEED symbols; ties are sorted on until none is left.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(_SEED, text.dtype)])
    key = np.zeros(n, _U)
    ended = np.zeros(n, bool)
    for i in range(_SEED):  # what lies behind a stop doesn't count
        symbol = padded[i : i + n].copy()
        symbol[ended] = 0
        key <<= _U(9)
        key |= symbol
        ended |= symbol == 0
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    over = ended[order]
    edge = np.ones(n, bool)
    edge[1:] = (key[1:] != key[:-1]) | over[1:] | over[:-1]  # a key with a stop is unlike any other, if only by its place
    del key, over, ended
    first_edge = edge.copy()
    places = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(edge, places, 0))
    h = _SEED
    while True:
        at = np.flatnonzero(~(edge & np.append(edge[1:], True)))
        if not len(at):
            return order, first_edge
        pos = order[at]
        pair = rank[pos] * np.int64(n + 1) + rank[np.minimum(pos.astype(np.int64) + h, n - 1)]
        again = np.argsort(pair, kind="stable")
        order[at] = pos[again]
        pair = pair[again]
        edge[at] |= np.concatenate([[True], pair[1:] != pair[:-1]])
        del pair, again, pos
        rank[order[at]] = np.maximum.accumulate(np.where(edge, places, 0))[at]
        h *= 2


def shared_prefixes(strings: list[np.ndarray], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each string (its bytes): (starts of length-byte substrings, number of their class); equal ones have one class."""
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes) - 1
    n = int(sizes.sum())
    text = np.zeros(n, np.uint16)
    for s, e in zip(strings, ends, strict=True):
        text[e - len(s) : e] = s.astype(np.uint16) + 1
    order, known = suffix_array(text, ends)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = order - 1
    bwt = np.where(before >= 0, text[before], np.uint16(0))
    last_to_first = place[before]
    del before, place
    ends_of_runs = np.append(bwt[1:] != bwt[:-1], True)
    same_until = np.repeat(np.flatnonzero(ends_of_runs).astype(np.int32), np.diff(np.flatnonzero(np.append(True, ends_of_runs))))
    placed = np.append(known, True)  # placed[r]: the common prefix of ranks r - 1 and r is known to be shorter
    lo = np.flatnonzero(known)
    hi = np.append(lo[1:], n) - 1
    keep = text[order[lo]] > 0
    lo, hi = lo[keep], hi[keep]
    for _ in range(_SEED, length):
        if not len(lo):
            break
        plain = same_until[lo] >= hi  # all are preceded by one symbol: one interval, by its ends
        l1, h1 = lo[plain & (bwt[lo] > 0)], hi[plain & (bwt[lo] > 0)]
        new_lo, new_hi = [last_to_first[l1].astype(np.int64)], [last_to_first[h1].astype(np.int64)]
        l2, h2 = lo[~plain], hi[~plain]
        if len(l2):
            size = h2 - l2 + 1
            start = np.cumsum(size) - size
            at = np.arange(size.sum()) - np.repeat(start - l2, size)
            owner = np.repeat(np.arange(len(l2)), size)[bwt[at] > 0]
            at = at[bwt[at] > 0]
            if len(at):
                group = owner * 257 + bwt[at].astype(np.int64)
                o = np.lexsort((last_to_first[at], group))
                group, target = group[o], last_to_first[at][o].astype(np.int64)
                begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                new_lo.append(target[begin])
                new_hi.append(target[np.append(begin[1:], len(target)) - 1])
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~placed[hi + 1]
        placed[hi[fresh] + 1] = True
        lo, hi = lo[fresh], hi[fresh]
    klass = np.empty(n, np.int32)
    klass[order] = np.cumsum(placed[:-1], dtype=np.int32)
    return [(np.arange(max(0, len(s) - length + 1)), klass[e - len(s) : e - len(s) + max(0, len(s) - length + 1)]) for s, e in zip(strings, ends, strict=True)]


def _ranges(flags: np.ndarray) -> list[int]:
    """First and last of each run of true flags, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            data, offs = binary_column(b.column("text"))
            r = runs_of(data, offs, length)
            d = b.column("d").take(pa.array(r.pop("doc")))
            yield pa.RecordBatch.from_arrays([d, *(pa.array(v, pa.int64() if k in ("bin", "content") else pa.int32()) for k, v in r.items())], names=["d", *r])

    return docs.select("d", "text").mapInArrow(run, "d long, start int, strings int, bin long, content long, twice int")


def _indexed(pieces: DataFrame, length: int) -> DataFrame:
    """(bin, content, ranges) of the runs of contested bins (bin, content, copies, bytes), a bin in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            strings = [np.frombuffer(r[3], np.uint8) for r in rows]
            found = shared_prefixes(strings, length)
            classes = np.concatenate([k for _, k in found])
            weight = np.bincount(classes, np.repeat([r[2] for r in rows], [len(k) for _, k in found])) if len(classes) else np.zeros(1)
            out = [_ranges(weight[k] > 1) for _, k in found]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["bin", "content", "ranges"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("bin", "content", "copies", "bytes")), strict=True):
                if size > BATCH and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield settle(held)

    sorted_rows = pieces.select("bin", "content", "copies", "bytes").repartition("bin").sortWithinPartitions("bin")
    return sorted_rows.mapInArrow(run, "bin long, content long, ranges array<bigint>")


def _hashed(pieces: DataFrame, length: int) -> DataFrame:
    """The same for bins too large to index: one row for each string, counted before it moves."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "bytes"):
            for bin_, content, copies, raw in zip(*(b.column(c).to_pylist() for c in ("bin", "content", "copies", "bytes")), strict=True):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - length + 1)
                n = len(at)
                yield pa.RecordBatch.from_pydict({"bin": np.full(n, bin_), "content": np.full(n, content), "copies": np.full(n, copies), "at": at, "h": tv.Spans(data).hash(at, at + length).view(np.int64)})

    rows = pieces.select("bin", "content", "copies", "bytes").mapInArrow(strings, "bin long, content long, copies long, at long, h long")
    often = rows.groupBy("h").agg(F.sum("copies").alias("c")).where("c > 1").select("h")
    places = rows.join(often, "h", "left_semi").groupBy("bin", "content").agg(F.array_sort(F.collect_set("at")).alias("places"))
    return places.select("bin", "content", F.flatten(F.transform("places", lambda x: F.array(x, x))).alias("ranges"))


def _split(pieces: DataFrame, length: int) -> DataFrame:
    """The same for bins too large to index at once: their runs are cut by another minimizer, and its bins settled in turn.

    Equal strings share both minimizers.  A string list that one minimizer can't part (all
    hold one passage) is mostly parted by another; what stays too large is hashed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "bytes"):
            for bin_, content, copies, raw in zip(*(b.column(c).to_pylist() for c in ("bin", "content", "copies", "bytes")), strict=True):
                data = np.frombuffer(raw, np.uint8)
                r = runs_of(data, np.array([0, len(data)]), length, seed=0x5DEECE66D)
                n = len(r["start"])
                inner = tv.mix(r["bin"].view(_U) ^ tv.mix(np.full(n, bin_, np.int64).view(_U))).view(np.int64)
                parts = [raw[a : a + k + length - 1] for a, k in zip(r["start"].tolist(), r["strings"].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"bin": np.full(n, bin_), "content": np.full(n, content), "off": r["start"], "strings": r["strings"], "bin2": inner, "content2": r["content"], "twice": r["twice"], "copies": np.full(n, copies), "bytes": pa.array(parts, pa.binary())})

    kinds = "bin long, content long, off long, strings long, bin2 long, content2 long, twice long, copies long, bytes binary"
    rows = written(pieces.select("bin", "content", "copies", "bytes").mapInArrow(run, kinds), "split")
    distinct = rows.groupBy("bin2", "content2").agg(F.sum("copies").alias("copies"), F.max("twice").alias("twice"), F.first("strings").alias("strings"), F.first("bytes").alias("bytes"))
    distinct = written(distinct, "inner")
    bins = distinct.groupBy("bin2").agg(F.count("*").alias("kinds"), F.max("twice").alias("t"), F.sum(F.length("bytes")).alias("size")).where("kinds > 1 OR t > 0")
    contested = distinct.join(bins.select("bin2", "size"), "bin2").select(F.col("bin2").alias("bin"), F.col("content2").alias("content"), "copies", "bytes", "size")
    found = _indexed(contested.where(F.col("size") <= MOST), length).unionByName(_hashed(contested.where(F.col("size") > MOST), length))
    whole = distinct.where("copies > 1").select(F.col("bin2").alias("bin"), F.col("content2").alias("content"), F.array(F.lit(0).cast("long"), F.col("strings") - 1).alias("ranges"))
    verdict = found.where(F.size("ranges") > 0).unionByName(whole).groupBy("bin", "content").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    inner = rows.select("bin", "content", "off", "bin2", "content2").join(verdict.withColumnsRenamed({"bin": "bin2", "content": "content2"}), ["bin2", "content2"])
    moved = inner.select("bin", "content", F.transform("ranges", lambda x: x + F.col("off")).alias("ranges"))
    return moved.groupBy("bin", "content").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, cuts) of documents (d, text): [first, end) pairs of bytes covered by a string of `length` bytes that starts elsewhere too."""
    runs = written(_runs(docs, length), "runs")
    distinct = runs.groupBy("bin", "content").agg(F.count("*").alias("copies"), F.max("twice").alias("twice"), F.first("strings").alias("strings"), F.min(F.struct("d", "start")).alias("at"))
    distinct = written(distinct, "distinct")
    bins = distinct.groupBy("bin").agg(F.count("*").alias("kinds"), F.max("twice").alias("t"), F.sum(F.col("strings").cast("long") + length - 1).alias("size")).where("kinds > 1 OR t > 0")
    contested = distinct.join(bins.select("bin", "size"), "bin").select("bin", "content", "copies", "strings", "at", "size")
    wanted = contested.groupBy(F.col("at.d").alias("d")).agg(F.collect_list(F.struct(F.col("at.start").alias("start"), "strings", "bin", "content", "copies", "size")).alias("rows"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            out: list[tuple] = []
            for t, rows in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("rows").to_pylist(), strict=True):
                out += [(r["bin"], r["content"], r["copies"], r["size"], t[r["start"] : r["start"] + r["strings"] + length - 1]) for r in rows]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["bin", "content", "copies", "size", "bytes"])

    texts = only_these(docs, written(wanted, "wanted"), "d", array="rows").select("text", "rows")
    pieces = written(texts.mapInArrow(cut, "bin long, content long, copies long, size long, bytes binary"), "pieces").dropDuplicates(["bin", "content"])
    found = _indexed(pieces.where(F.col("size") <= MOST), length)
    large = pieces.where(F.col("size") > MOST)
    if large.limit(1).count():
        found = found.unionByName(_split(large, length))
    # a run that occurs twice is repeated as a whole, whatever its bin
    whole = distinct.where("copies > 1").select("bin", "content", F.array(F.lit(0).cast("long"), F.col("strings").cast("long") - 1).alias("ranges"))
    verdict = written(found.where(F.size("ranges") > 0).unionByName(whole), "verdict").groupBy("bin", "content").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    cuts = runs.join(verdict, ["bin", "content"]).select("d", F.transform("ranges", lambda x, i: x + F.col("start") + F.when(i % 2 == 1, length).otherwise(0)).alias("cuts"))
    cuts = cuts.groupBy("d").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    return written(cuts.mapInArrow(_merged, "d long, cuts array<bigint>"), "cuts")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, cuts) with cuts that touch made one, in order."""
    for b in batches:
        out = []
        for cuts in b.column("cuts"):
            c = cuts.values.to_numpy().reshape(-1, 2)
            c = c[np.argsort(c[:, 0], kind="stable")]
            reach = np.maximum.accumulate(c[:, 1])
            new = np.append(True, c[1:, 0] > reach[:-1])
            out.append(np.stack([c[new, 0], reach[np.append(new[1:], True)]], 1).ravel())
        yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(out, pa.list_(pa.int64()))], names=["d", "cuts"])


def _covered(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(d, of, base, text): the spans of at least `length` bytes as texts of their own, named by document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            data, offs = binary_column(b.column("text"))
            of, base, found = [], [], []
            for d, at, cuts in zip(b.column("d").to_pylist(), offs[:-1].tolist(), b.column("cuts").to_pylist(), strict=True):
                for lo, hi in zip(cuts[::2], cuts[1::2], strict=True):
                    if hi - lo >= length:
                        of.append(d)
                        base.append(lo)
                        found.append(data[at + lo : at + hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(base, pa.int64()), pa.array(found, pa.binary())], names=["of", "base", "text"])

    whole = F.expr(f"exists(sequence(1, size(cuts) - 1, 2), i -> cuts[i] - cuts[i - 1] >= {length})")
    texts = only_these(docs.select("d", "text"), spans.where("size(cuts) > 0").where(whole), "d", array="cuts")
    return written(texts.mapInArrow(run, "of long, base long, text binary").withColumn("d", F.xxhash64("of", "base")), "covered")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int | None = PASSAGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_passages) of every row.

    Bytes covered by a string of `length` bytes that starts anywhere else go.  n_passages
    counts the maximal spans covered by repeated strings of `passage` bytes; only in these
    spans can longer strings repeat, so only they are searched for them.  Without a
    `passage` below `length`, n_passages is n_spans.

    Null text is empty; a text shorter than `length` bytes keeps all.  Of equal texts all
    go, as each string of one starts in the others too: repeated rows count as each
    other's copies.  An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("d", F.xxhash64("doc_id", "text"))
    if passage is not None and passage < length:
        short = repeated(docs, passage)
        parts = _covered(docs, short, length)
        moved = repeated(parts, length).join(parts.select("d", "of", "base").distinct(), "d").select(F.col("of").alias("d"), F.transform("cuts", lambda x: x + F.col("base")).alias("cuts"))
        cuts = moved.groupBy("d").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
        table = short.select("d", (F.size("cuts") / 2).cast("long").alias("n_passages")).join(cuts, "d", "left")
    else:
        table = repeated(docs, length).withColumn("n_passages", (F.size("cuts") / 2).cast("long"))
    table = written(table.select("d", "n_passages", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts")), "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            data, offs = binary_column(b.column("text"))
            removed, spans, kept = [], [], []
            for i, cuts in enumerate(b.column("cuts").to_pylist()):
                raw = data[offs[i] : offs[i + 1]]
                c = np.array(cuts or [], np.int64).reshape(-1, 2)
                whole = np.ones(len(raw), bool)
                for lo, hi in c.tolist():  # apart from each other
                    whole[lo:hi] = False
                removed.append(int((c[:, 1] - c[:, 0]).sum()))
                spans.append(len(c))
                kept.append(raw[whole].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offs).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), b.column("n_passages")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = only_these(docs, table, "d", "left", "cuts").select("doc_id", "text", "cuts", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long")
