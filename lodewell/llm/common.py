"""Shared plumbing of the training-data operators: shared-folder tables, Arrow slices, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir, written  # noqa: F401

#: Bytes of text that one vectorised step handles at a time.
SLICE_BYTES = 2 << 20


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text (a longer text has a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


#: Keys, and entries of arrays beside them, that may be sent to every task: at most 56 bytes each.
BROADCAST_ENTRIES = 1_000_000


def only_these(rows: DataFrame, wanted: DataFrame, key: str, how: str = "inner", array: str | None = None) -> DataFrame:
    """`rows` joined with the few `wanted`, one row a key.  Keys and entries of `array` are counted first:
    few, they go to where the rows are, so that no text is shuffled; beyond the bound both are shuffled."""
    entries = F.sum(F.lit(1) + (F.size(array) if array else F.lit(0)))
    if (wanted.agg(entries).first()[0] or 0) <= BROADCAST_ENTRIES:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, key, how)


#: Edges (16 bytes each) up to which one task finds components by union-find.
EDGES_OF_ONE_TASK = 500_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) that come in."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            p, q = top(u), top(v)
            root.setdefault(u, p)
            root.setdefault(v, q)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in `edges(a, b)`, both bigint; component is the smallest node reachable.

    Edges are counted first.  Up to `EDGES_OF_ONE_TASK`, one task unites them; beyond it,
    alternating large-star and small-star steps (Kiveris et al. 2014): every round is
    two aggregations over the edges, which a hub does not overload, since minima are
    taken before the shuffle and stars, not pairs, are written.  Each round is written
    to the shared folder, so a lost executor costs one round.  Ends when the edges no
    longer change (edge count and checksum).
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "cc")

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.expr("cast(hash(u, v) as long)"))).first())

    before = state(e)
    if before[0] <= EDGES_OF_ONE_TASK:
        return written(e.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: each node's larger neighbours go to its smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node's smaller neighbours and itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        nxt = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(nxt, "cc")
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))
