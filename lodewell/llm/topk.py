"""Exact top-k by inner product: no-random-access aggregation over sorted lists, in blocks.

Every component of the vectors is a list sorted by value; a query reads a list from its
high end where its weight is positive and from its low end where it is negative, all
lists in turn and in order, a stretch at a time.  What a vector has shown so far, plus
the frontier of each list it hasn't been met in, bounds its score from above; plus the far
end of these lists, from below.  Vectors whose upper bound is below the k-th best lower
bound drop out.  A query stops when nothing unseen can qualify and few vectors are left;
their final scores are resolved.

With the frontier f of a list, a vector's contribution bound is w * max(x, f), met or not,
so the bounds of what is left of a block at one depth are one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a block, about, and queries handled together; both bound a task's memory.
BLOCK = 4096
QUERIES = 256
#: Parts of each list that have been read after each stretch; a query that can't stop by then has its last vectors resolved.
STRETCHES = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16)
#: A query whose outsiders are out resolves the final scores of up to so many times k vectors at once.
LEFT = 4


def search_block(queries: np.ndarray, vectors: np.ndarray, k: int, stretches: tuple[float, ...] = STRETCHES) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each query (rows, scores) of all vectors that may be among its k best (at least every one with a k-th best
    score or more), and the number of list entries that each query read."""
    n, d = vectors.shape
    most = int(max(map(abs, (queries.max(initial=0), queries.min(initial=0))))) * int(max(map(abs, (vectors.max(initial=0), vectors.min(initial=0))))) * max(d, 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object  # whole numbers in any case
    read = np.zeros(len(queries), np.int64)
    alive = np.ones((len(queries), n), bool)
    if n > k and d and len(queries):
        both = np.concatenate([vectors, -vectors], 1).T  # one list for each component and direction
        ordered = np.sort(both, 1)[:, ::-1]
        far = ordered[:, -1:].astype(kind)
        lists = both.astype(kind)
        weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], 1).astype(kind)
        going, columns = np.arange(len(queries)), np.arange(n)
        for stretch in stretches:
            frontier = ordered[:, min(n - 1, int(stretch * n))]
            depth = n - (both < frontier[:, None]).sum(1)  # entries equal to the frontier are read too
            frontier = frontier.astype(kind)[:, None]
            w, part = weights[going], lists[:, columns]
            upper = w @ np.maximum(part, frontier)
            lower = w @ np.where(part >= frontier, part, far)
            bar = np.sort(lower, 1)[:, -k] if kind is object else np.partition(lower, len(columns) - k, 1)[:, len(columns) - k]
            read[going] = (queries[going] > 0) @ depth[:d] + (queries[going] < 0) @ depth[d:]
            alive[np.ix_(going, columns)] &= upper >= bar[:, None]
            outside = (w @ frontier)[:, 0] >= bar  # something that no list has shown may still qualify
            done = ~outside & (alive[going].sum(1) <= LEFT * k)
            going = going[~done]
            if not len(going):
                break
            columns = np.flatnonzero(alive[going].any(0))
    out = []
    exact = vectors.astype(object if kind is object else np.int64 if kind is np.int64 else np.float64)
    for i, q in enumerate(queries):
        rows = np.flatnonzero(alive[i])
        scores = (exact[rows] @ q.astype(exact.dtype)).astype(np.int64) if d else np.zeros(len(rows), np.int64)
        if len(rows) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[keep], scores[keep]
        out.append((rows, scores))
    return out, read


def _packed(df: DataFrame, blocks: int, width: int) -> DataFrame:
    """(block, ats, vectors): the rows of `df(v, at)` dealt over blocks by hash, positions and zero-padded vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def flush() -> pa.RecordBatch:
            at, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([at.tobytes()]), pa.array([v.tobytes()])], names=["block", "ats", "vectors"])

        for b in batches:
            block = b.column("block").to_numpy()
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() if len(block) else []
            for lo, hi in zip(edges, [*edges[1:], len(block)], strict=True):
                if held and block[lo] != now:
                    yield flush()
                now = int(block[lo])
                part = b.slice(lo, hi - lo)
                v = np.zeros((hi - lo, width), np.int64)
                col = part.column("v")
                lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)
                v[np.arange(width) < lengths[:, None]] = col.flatten().to_numpy()
                held.append((part.column("at").to_numpy(), v))
        if held:
            yield flush()

    dealt = df.select(F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int").alias("block"), "v", "at")
    return dealt.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, "block int, ats binary, vectors binary")


def top_k(table: DataFrame, is_query, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of every row for which `is_query` holds.

    Vectors null, or with null or non-finite components, take no part, as do rows with a
    null key.  Components become floor(scale * x) as 64-bit numbers, scores are exact;
    a score to be returned that needs more than 64 bits raises an error.  Ties go to the
    smaller id.  Fewer rows than k: all of them.  Equal vectors are searched once: only the
    k + 1 smallest ids of a vector can be returned, so a frequent vector stays one row.  A
    repeated id with the same vector counts once.  Vectors of unequal length are padded by
    zeros.  An empty table, or no query, gives no rows; other columns are not read.

    Queries and vectors are dealt over blocks by hash; every block of queries meets every
    block of vectors in the task of the latter, so the work is spread over as many tasks.
    """
    raw = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    raw = raw.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = raw.select("id", F.transform("x", lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("long")).alias("v"))
    rows = rows.withColumn("h", F.xxhash64("v"))
    # ids of a frequent vector: the k + 1 smallest, found in two steps so that no task holds them all
    n_salts = 32
    salted = Window.partitionBy("h", "v", F.pmod(F.xxhash64("id"), F.lit(n_salts))).orderBy("id")
    least = rows.distinct().withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    least = written(least.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")).withColumn("at", F.col("ids")[0]), "vectors")
    size = least.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width = int(size["w"] or 0)
    blocks = max(1, -(-int(size["n"]) // BLOCK))
    asked = rows.where(is_query(F.col("id"))).select("id", "h", "v").distinct()
    asked_once = written(asked.groupBy("h", "v").agg(F.min("id").alias("at")), "asked")
    held = _packed(least, blocks, width)
    ask_blocks = written(_packed(asked_once, max(1, -(-asked_once.count() // BLOCK)), width), "queries")
    # every block of queries goes to every block of vectors
    dealt = ask_blocks.select(F.col("ats").alias("q_ats"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = held.join(dealt.repartition(blocks, "block").hint("merge"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                q_at, at = (np.frombuffer(b.column(c)[r].as_py(), np.int64) for c in ("q_ats", "ats"))
                q, v = (np.frombuffer(b.column(c)[r].as_py(), np.int64).reshape(-1, width) for c in ("q_vectors", "vectors"))
                for lo in range(0, len(q), QUERIES):
                    found, _ = search_block(q[lo : lo + QUERIES], v, k + 1)
                    counts = [len(x) for x, _ in found]
                    yield pa.RecordBatch.from_pydict({"q_at": np.repeat(q_at[lo : lo + QUERIES], counts), "at": at[np.concatenate([x for x, _ in found])], "score": np.concatenate([s for _, s in found])})

    found = pairs.select("q_ats", "q_vectors", "ats", "vectors").mapInArrow(run, "q_at long, at long, score long")
    # of each block at most k + 1 vectors and their ties come; the ranks below take the best of all blocks
    per_query = Window.partitionBy("q_at").orderBy(F.desc("score"), "at")
    found = found.withColumn("r", F.row_number().over(per_query)).where(F.col("r") <= k + 1).drop("r")
    spread = found.join(least.select("at", "ids"), "at").select("q_at", "score", F.explode("ids").alias("vec_id"))
    each = asked.join(asked_once.withColumnRenamed("at", "q_at"), ["h", "v"]).select(F.col("id").alias("query_id"), "q_at")
    ranked = each.join(spread, "q_at").where("vec_id <> query_id")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
