"""Bootstrap intervals with draws by whole-number arithmetic: the same on any cluster and in SQL."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import positioned

#: Modulus and multipliers of the draws, and what a draw must reach to take a row once, twice and so on:
#: the distribution of Poisson(1) in parts of the modulus (fixed values, used in SQL too).
MODULUS = 2147483647
MULTIPLIERS = (48271, 40692, 16807)
REACH = (790015084, 1580030168, 1975037710, 2106706891, 2139624186, 2146207645, 2147304888)
#: Draws that are made at a time, a processor's cache full.
STEP = 1 << 20


def draws_of(i: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """How often draw b takes row i, for all pairs: (rows x draws) whole numbers."""
    x = (i[:, None] * MULTIPLIERS[0] + b[None, :] * MULTIPLIERS[1] + seed) % MODULUS
    for m in MULTIPLIERS:
        x = ((x ^ (x >> 15)) * m) % MODULUS
    return sum((x >= r).astype(np.int64) for r in REACH)


def bootstrap(values: DataFrame, order: str, columns: Sequence[str], draws: int = 1000, seed: int = 13, level: float = 0.95) -> DataFrame:
    """(metric, n, mean, lo, hi): percentile intervals of means over resampled rows.

    Each draw takes every row so often as Poisson(1) says, which in many rows is drawing
    with replacement; row and draw alone decide, so a task sums its own rows for all draws
    and returns one array of sums and one of counts for each metric, however many rows
    and draws there are.  Missing values are left out of a metric; a draw without any has
    no mean.  Rows are numbered by `order`, which must be total.
    """
    numbered = positioned(values.select(order, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_{n}") for n, c in enumerate(columns)]), [order], "_i")
    numbers = [f"_{n}" for n in range(len(columns))]
    every = np.arange(draws, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(columns), draws)), np.zeros((len(columns), draws), np.int64)
        for batch in batches:
            i = batch.column("_i").to_numpy()
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in numbers])
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            step = max(1, STEP // draws)
            for lo in range(0, len(i), step):
                taken = draws_of(i[lo : lo + step], every, seed)
                sums += x[:, lo : lo + step] @ taken.astype(float)
                counts += there[:, lo : lo + step].astype(np.int64) @ taken
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(columns))), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(counts.tolist(), pa.list_(pa.int64()))], names=["metric", "sums", "counts"])

    tasks = numbered.select("_i", *numbers).mapInArrow(run, "metric int, sums array<double>, counts array<long>")
    drawn = tasks.select("metric", F.posexplode(F.arrays_zip("sums", "counts")).alias("b", "x")).groupBy("metric", "b").agg(F.sum("x.sums").alias("s"), F.sum("x.counts").alias("w"))
    tail = (1 - level) / 2
    m = F.try_divide(F.col("s"), F.col("w"))
    bounds = drawn.withColumn("m", m).groupBy("metric").agg(F.expr(f"percentile(m, {tail})").alias("lo"), F.expr(f"percentile(m, {1 - tail})").alias("hi"))
    plain = numbered.select(F.posexplode(F.array(*numbers)).alias("metric", "x")).groupBy("metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("metric") + 1).alias("metric")
    return plain.join(bounds, "metric").select(name, "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])
