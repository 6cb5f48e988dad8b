"""Ranked lexical search: postings are traversed in fixed windows of document ids, scores are scattered into small arrays.

Texts are read once, for the postings of asked terms.  These are dealt by ranges of ids;
a task takes one window of ids after another, lays its postings out by term, adds each
query's into an array of the window's size, marks what was touched in a bitset, and
harvests the touched places into the query's heap.  A task returns its heaps, no more.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, sliced, written

#: Documents of a window: its scores are 32 KB, which stay in a core's cache.
WINDOW = 4096
#: Query terms, repeats counted, that are searched for in one reading of the texts; more are taken in blocks.
TERMS_AT_ONCE = 1_000_000
#: Bytes that end a term become spaces, capital ASCII letters small; all else is part of a term.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, "text"):
        data, offsets = binary_column(b.column("text"))
        whole, ends = data.tobytes(), offsets.tolist()
        for i, q in enumerate(b.column("query").to_pylist()):
            found = Counter(terms_of(whole[ends[i] : ends[i + 1]]))
            yield pa.RecordBatch.from_pydict({"query": pa.array([q] * len(found), pa.int64()), "term": pa.array(list(found), pa.binary()), "times": pa.array(list(found.values()), pa.int64())})


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, key, term, times), written out; every row is a query of its own, whatever its key."""
    numbered = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "queries")
    counted = numbered.select("query", "text").mapInArrow(_asked, "query long, term binary, times long")
    return written(counted.join(numbered.select("query", "key"), "query"), "query-terms")


def postings(docs: DataFrame, terms: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(doc, n, terms, times) of every row with a term at all: its terms' number with repeats, the asked ones and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.get
        for b in sliced(batches, "text"):
            data, offsets = binary_column(b.column("text"))
            whole, ends = data.tobytes(), offsets.tolist()
            rows, n, found, times, sizes = [], [], [], [], [0]
            for i in range(b.num_rows):
                words = terms_of(whole[ends[i] : ends[i + 1]])
                if not words:
                    continue
                counts = Counter(map(number, words))
                counts.pop(None, None)
                rows.append(i)
                n.append(len(words))
                found.extend(counts)
                times.extend(counts.values())
                sizes.append(len(found))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))],
                names=["doc", "n", "terms", "times"],
            )

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc long, n long, terms array<int>, times array<int>")


class Windows:
    """Scores the windows given one after another; keeps each query's `k` best in a heap.

    `asked` holds for each query its (term, times).  An entry of a heap is (score, -place
    of the key, key); a null key stands after every other.
    """

    def __init__(self, asked: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.asked, self.weights, self.k = asked, weights, k
        self.n_docs, self.n_terms = n_docs, n_terms
        self.heaps: list[list[tuple]] = [[] for _ in asked]
        self.added = 0  # postings added to scores

    def score(self, keys: np.ndarray, nulls: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        """One window: ascending `keys` of its documents, and postings (doc, term, times) with doc as a place among them."""
        order = np.argsort(term, kind="stable")
        doc, term, times = doc[order], term[order], times[order].astype(np.int64)
        m = 25 + (75 * n * self.n_docs) // self.n_terms
        parts = self.weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
        there, starts = np.unique(term, return_index=True)
        ends = np.append(starts[1:], len(term)).tolist()
        starts, place = starts.tolist(), {t: i for i, t in enumerate(there.tolist())}
        words = -(-len(keys) // 8)
        bits = np.zeros((len(there), words), np.uint8)  # each term's documents
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(there)), np.diff([*starts, len(term)])), doc >> 3), (0x80 >> (doc & 7)).astype(np.uint8))
        scores = np.zeros(len(keys), np.int64)
        for q, asked in enumerate(self.asked):
            seen = np.zeros(words, np.uint8)
            for t, repeats in asked:
                i = place.get(t)
                if i is None:
                    continue
                a, b = starts[i], ends[i]
                scores[doc[a:b]] += parts[a:b] if repeats == 1 else repeats * parts[a:b]  # a term has a document once
                seen |= bits[i]
                self.added += b - a
            touched = np.flatnonzero(np.unpackbits(seen, count=len(keys)))
            if len(touched):
                self._harvest(q, keys, nulls, touched, scores[touched])
                scores[touched] = 0

    def _harvest(self, q: int, keys: np.ndarray, nulls: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        heap = self.heaps[q]
        least = heap[0][0] if len(heap) == self.k else 1
        keep = scores >= least
        places, scores = places[keep], scores[keep]
        if len(places) > self.k:
            best = np.argsort(-scores, kind="stable")[: self.k]
            places, scores = places[best], scores[best]
        for score, key, null in zip(scores.tolist(), keys[places].tolist(), nulls[places].tolist(), strict=True):
            entry = (score, -math.inf if null else -key)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _search(found: DataFrame, lists: dict[int, list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, window: int) -> DataFrame:
    queries, asked = list(lists), list(lists.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Windows(asked, weights, n_docs, n_terms, k)
        held: list[tuple] = []  # parts of the window that is being gathered
        size, now = 0, None

        def flush() -> None:
            if held:
                keys, nulls, n, counts, term, times = (np.concatenate(x) for x in zip(*held, strict=True))
                scan.score(keys, nulls, n, np.repeat(np.arange(len(keys)), counts), term, times)
                held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            nulls = np.asarray(b.column("doc").is_null())
            keys = b.column("doc").fill_null(0).to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy(zero_copy_only=False)
            lists = b.column("terms")
            offsets = lists.offsets.to_numpy()
            term, times = lists.values.to_numpy(zero_copy_only=False), b.column("times").values.to_numpy(zero_copy_only=False)
            shift = b.column("times").offsets.to_numpy()[0] - offsets[0]
            of = np.where(nulls, -1, keys // window)
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (nulls[1:] != nulls[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if now != (nulls[lo], of[lo]):
                    flush()
                    now, size = (nulls[lo], of[lo]), 0
                while lo < hi:  # repeated ids may overfill a window; it is then scored in parts
                    if size == window:
                        flush()
                        size = 0
                    to = min(hi, lo + window - size)
                    x, y = offsets[lo], offsets[to]
                    held.append((keys[lo:to], nulls[lo:to], n[lo:to], np.diff(offsets[lo : to + 1]), term[x:y], times[x + shift : y + shift]))
                    size += to - lo
                    lo = to
        flush()
        rows = [(queries[q], None if key == -math.inf else -key, score) for q, heap in enumerate(scan.heaps) for score, key in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query", "doc", "score"])

    # a window goes to one task, unless rows of its ids are so many that their hashes divide it
    dealt = found.where("size(terms) > 0").withColumn("part", F.expr(f"doc div {window}")).repartitionByRange("part", F.hash("doc", "n", "terms"))
    return dealt.sortWithinPartitions("part", "doc").select("doc", "n", "terms", "times").mapInArrow(run, "query long, doc long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents with a score above 0 of every row of `queries`.

    Scores are whole numbers (see `weight` and `Windows.score`); equal ones go by
    ascending key, null keys last.  Null and empty texts have no terms: such documents
    are not counted, such queries have no rows.  Rows are documents and queries of their
    own, so repeated rows are found or answered each; texts are read whole, whatever
    their length; other columns are not read; empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = query_terms(queries, query_key, query_text)
    blocks = max(1, -(-(asked.agg(F.sum("times")).first()[0] or 0) // TERMS_AT_ONCE))
    out = spark.createDataFrame([], f"item_id {queries.schema[query_key].dataType.simpleString()}, rank int, doc_id long, score long")
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        numbers: dict[bytes, int] = {}
        lists: dict[int, list[tuple[int, int]]] = {}
        for r in part.select("query", "term", "times").collect():  # about TERMS_AT_ONCE rows at most
            lists.setdefault(r["query"], []).append((numbers.setdefault(bytes(r["term"]), len(numbers)), r["times"]))
        if not numbers:
            continue
        found = written(postings(docs, numbers, key, text), "postings")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weights = np.zeros(len(numbers), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each asked term at most
            weights[r["term"]] = weight(n_docs, r["count"])
        best = _search(found, lists, weights, n_docs, n_terms, k, window)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k).join(part.select("query", "key").distinct(), "query")
        out = out.union(best.select("key", "rank", "doc", "score"))
    return out


def weight(n_docs: int, df: int) -> int:
    """Of a term that `df` of `n_docs` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
