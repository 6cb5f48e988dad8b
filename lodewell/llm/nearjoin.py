"""Near-duplicate documents: a chosen-path set similarity join on minwise hashes, links confirmed on full shingle sets.

Recursion.  In each of a few independent trees a document set sits in nodes.  A node
picks two of the minwise coordinates by its own hash, and each of its documents goes to
the two children named by its values there; documents that share a child go on together.
A node of at most `SMALL` documents is a leaf and compared exhaustively; so is one at
`DEPTH`, in cells of bounded size.  A pair of Jaccard similarity J keeps a common child
with probability 1 - (1 - J)**2 a level, and the number of trees follows from the recall
that is asked for.

Comparing.  Documents with one set are one row.  A leaf's comparison reads one-byte
sketches; what may be similar enough is confirmed on full sets.  A large group of copies
needs no more than the links that connect it, so a leaf first gives a most-similar
spanning forest of its documents; the components of what is confirmed are then compared
with each other only.  No link that would join two components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import binary_column, only_these, sliced, written
from .linking import link

#: Minwise coordinates, and so bytes of a sketch.
COORDINATES = 128
#: Children of a node that a document goes to.
CHOSEN = 2
DEPTH = 3
SMALL = 256
#: Chance that a pair at the threshold shares a leaf.
RECALL = 0.99999

_U = np.uint64
_SEEDS = tv.mix(np.arange(COORDINATES, dtype=_U) + _U(0x5851F42D4C957F2D)) | _U(1)


def trees_for(threshold: float, recall: float = RECALL) -> int:
    """Trees that give `recall` at the threshold: a branch dies out with the least root of q = (1 - J + J q)**CHOSEN."""
    q = 0.0
    for _ in range(DEPTH):
        q = (1 - threshold + threshold * q) ** CHOSEN
    return max(1, math.ceil(math.log(1 - recall) / math.log(q))) if q else 1


def shingles_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, hash) of each document's distinct shingles, grouped by document, and the number of documents.

    A-Z are lower-cased; a text of fewer than `size` words, but one, is one shingle.
    """
    data, offs = binary_column(column)
    data = tv.LOWER[data]
    n = len(offs) - 1
    s, e, doc = tv.words(data, offs)
    hashes = tv.Spans(data).hash(s, e)
    at, found = tv.windows(hashes, doc, size)
    docs = doc[at]
    counts = np.bincount(doc, minlength=n)
    firsts = np.cumsum(counts) - counts
    for k in range(1, size):  # whole sequences of k words
        short = np.flatnonzero(counts == k)
        if len(short):
            total = np.full(len(short), k * 0x2545F4914F6CDD1D & (1 << 64) - 1, _U)
            for i in range(k):
                total += tv.mix(hashes[firsts[short] + i] + _U(i * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            docs, found = np.concatenate([docs, short]), np.concatenate([found, tv.mix(total)])
    _, first = np.unique(found ^ tv.mix(docs.astype(_U)), return_index=True)
    docs, found = docs[first], found[first]
    order = np.argsort(docs, kind="stable")
    return docs[order], found[order], n


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, n, g, mh): set size, hash of the whole set, minwise hashes; n = 0 and null where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            doc, found, n = shingles_of(b.column("text"), size)
            counts = np.bincount(doc, minlength=n)
            some = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[some]
            whole = np.zeros(n, np.int64)
            values = np.zeros((len(some), COORDINATES), np.uint32)
            if len(some):
                sums = [np.add.reduceat(tv.mix(found + _U(k)), starts) for k in (1, 2)]
                whole[some] = tv.mix(tv.mix(sums[0]) + sums[1]).view(np.int64)
                for i, seed in enumerate(_SEEDS):
                    values[:, i] = np.minimum.reduceat((found ^ (seed >> _U(7))) * seed, starts) >> _U(32)
            mh: list = [None] * n
            for i, row in zip(some, values, strict=True):
                mh[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), pa.array(counts.astype(np.int64)), pa.array(whole, mask=counts == 0), pa.array(mh, pa.binary())],
                names=["doc_id", "row", "n", "g", "mh"],
            )

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n long, g long, mh binary")


def _chosen(node: np.ndarray) -> list[np.ndarray]:
    """The CHOSEN different coordinates of each node."""
    first = (tv.mix(node) % _U(COORDINATES)).astype(np.int64)
    step = (tv.mix(node ^ _U(0xA0761D6478BD642F)) % _U(COORDINATES - 1)).astype(np.int64) + 1
    return [first, (first + step) % COORDINATES]


def _children(rows: DataFrame, trees: int = 0) -> DataFrame:
    """(node, g) one level down; from the trees' roots if `trees` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            mh = binary_column(b.column("mh"))[0].view(np.uint32).reshape(-1, COORDINATES)
            g = b.column("g").to_numpy()
            above = [tv.mix(np.full(len(g), t + 1, _U)) for t in range(trees)] or [b.column("node").to_numpy().view(_U)]
            nodes = [tv.mix(node ^ tv.mix((mh[np.arange(len(g)), c].astype(_U) << _U(8)) + c.astype(_U))) for node in above for c in _chosen(node)]
            yield pa.RecordBatch.from_pydict({"node": np.concatenate(nodes).view(np.int64), "g": np.tile(g, len(nodes))})

    return rows.mapInArrow(run, "node long, g long")


def _leaves(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, g, size) of all leaves that hold two sets at least."""
    rows = _children(sets.select("g", "mh"), trees_for(threshold, recall))
    done = []
    for depth in range(1, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        rows = written(rows.join(sizes, "node"), f"level{depth}")
        big = rows.where(F.col("size") > SMALL)
        if depth == DEPTH or not big.limit(1).count():
            done.append(rows)
            break
        done.append(rows.where(F.col("size") <= SMALL))
        rows = _children(big.select("node", "g").join(sets.select("g", "mh"), "g").select("node", "g", "mh"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _like(threshold: float, sk_a: np.ndarray, sk_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(may be similar enough, equal sketch bytes); five standard errors below the threshold still pass."""
    same = (sk_a == sk_b).sum(-1)
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    return (same >= least * COORDINATES) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9), same


def _same(percent: int, a: bytes, b: bytes) -> bool:
    """Whether two full sets (sorted 64-bit hashes) are similar enough, in whole numbers."""
    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= percent * (len(both) - i)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(g, payload): the sorted hashes of the wanted sets, from the texts of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            doc, found, n = shingles_of(b.column("text"), size)
            counts = np.bincount(doc, minlength=n)
            ends = np.cumsum(counts)
            sets = [np.sort(found[e - c : e].view(np.int64)).tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(sets, pa.binary())], names=["g", "payload"])

    texts = only_these(docs, wanted, "row").select("g", "text")
    return texts.mapInArrow(run, "g long, payload binary").dropDuplicates(["g"])


def _components(docs: DataFrame, size: int, percent: int, recall: float) -> DataFrame:
    """(doc_id, row, n, least) of docs(doc_id, row, text): least is the least (doc_id, row) reachable, null without a key or a word."""
    threshold = percent / 100
    rows = written(_signatures(docs, size), "signatures")
    sets = rows.where("g IS NOT NULL AND doc_id IS NOT NULL").groupBy("g").agg(F.min(F.struct("doc_id", "row")).alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("mh").alias("mh"))
    sets = written(sets, "sets")
    leaves = _leaves(sets, threshold, recall)
    slim = _sketches(sets)
    members = written(leaves.join(slim, "g"), "leaves")

    def payloads(ids: DataFrame) -> DataFrame:
        return _sets(docs, written(sets.select("g", F.col("at.row").alias("row")).join(ids, "g", "left_semi"), "wanted"), size)

    comps = link(members, partial(_like, threshold), payloads, partial(_same, percent))
    named = sets.select("g", "at", "copies").join(comps.withColumnRenamed("node", "g"), "g", "left").where("copies > 1 OR component IS NOT NULL")
    named = named.withColumn("component", F.coalesce("component", "g"))
    least = named.groupBy("component").agg(F.min("at").alias("least"))
    of_set = named.join(least, "component").select("g", "least")
    return rows.select("doc_id", "row", "n", "g").join(of_set, "g", "left").select("doc_id", "row", "n", "least")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, row, text); a row is named by key and text, so equal keys may have unlike texts."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Links: 100 |A & B| >= percent |A | B| on sets of distinct `size`-word shingles.  A
    text that is null or without a word has no set and no link; equal texts always share
    one.  component_id is the least doc_id reachable, kept marks it.  Rows with a null
    key have no name to be linked by: they come back with a null component, kept.
    Repeated rows come back each, rows of one key and unlike texts are linked each by its
    own text.  An empty table gives no rows; other columns are not read.
    """
    out = _components(_rows(docs, key, text), size, percent, recall)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sketches(sets: DataFrame) -> DataFrame:
    """(g, n, sk): the low byte of each minwise hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = binary_column(b.column("mh"))[0].view(np.uint32).reshape(-1, COORDINATES).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("g"), b.column("n"), pa.array([x.tobytes() for x in raw], pa.binary())], names=["g", "n", "sk"])

    return sets.select("g", "n", "mh").mapInArrow(run, "g long, n long, sk binary")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """The documents with their columns, one of each component: the row with the least key.

    Rows with a null key, and texts that are null or without a word, stay.  Rows of equal
    key and text stay or go together; of unlike texts under one key each is judged by its
    text.  An empty table gives no rows.
    """
    found = _components(_rows(docs, key, text), size, percent, recall)
    gone = written(found.where("least IS NOT NULL AND (least.doc_id <> doc_id OR least.row <> row)").select(F.col("row").alias("__lw_row")).distinct(), "gone")
    marked = docs.withColumn("__lw_row", F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")))
    return only_these(marked, gone.withColumn("__lw_gone", F.lit(True)), "__lw_row", "left").where("__lw_gone IS NULL").select(*docs.columns)
