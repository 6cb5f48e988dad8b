"""Append logs and event windows as Structured Streaming.

The first two are the streaming form of resumable keyed logs; event windows are an
extension with no counterpart in batch-only pipelines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_seen(stream: DataFrame, keys: Sequence[str], ts: str, late: str = "1 day") -> DataFrame:
    """One row per key within the watermark; state older than it is let go."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def tumbling(events: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    """Counts by window; works on a stream (add a watermark) and on a table alike."""
    return events.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, ts: str, width: str, step: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, width, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def drained(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, exactly once by the checkpoint, to Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(stream: DataFrame, key: str, ts: str, tie: str, late: str = "400 days", keep_ms: int = 400 * 86_400_000) -> DataFrame:
    """Each key's last line by (ts, tie), whenever a batch has a later one: in `update` mode, for `upserted`.

    A key's state is the place of its last line, not the line.  A timer lets it go once
    the watermark is `keep_ms` past it; lines older than the watermark, which `late` sets,
    are not looked at, so what was let go cannot come back.  A null key or time is no line.
    """
    fields = stream.schema.fields
    place = [f"`{n}` {stream.schema[n].dataType.simpleString()}" for n in (ts, tie)]
    names = [f.name for f in fields]

    def newest(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms") if state.getCurrentWatermarkMs() > 0 else None
        best, held = None, (pd.Timestamp(state.get[0]), state.get[1]) if state.exists else None
        for rows in batches:
            for r in rows.sort_values([ts, tie]).tail(1).itertuples(index=False):
                at = (pd.Timestamp(getattr(r, ts)), getattr(r, tie))
                if (mark is None or at[0] >= mark) and (held is None or at > held):
                    best, held = rows.sort_values([ts, tie]).tail(1), at
        if best is not None:
            state.update((held[0].to_pydatetime(), held[1]))
            yield best[names]
        if held is not None:
            end = int(held[0].timestamp() * 1000) + keep_ms
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    lines = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return lines.groupBy(key).applyInPandasWithState(newest, lines.schema, ", ".join(place).replace("timestamp_ntz", "timestamp"), "update", GroupStateTimeout.EventTimeTimeout)


def upserted(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """All that is there now; each batch's rows go to a folder of its own, which a repeated batch replaces."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """The rows of an upserted folder: for each key that of the last batch that has it."""
    rows = spark.read.option("basePath", sink).parquet(sink)
    whole = F.struct(*[c for c in rows.columns if c != "batch"])
    return rows.groupBy(*keys).agg(F.max_by(whole, "batch").alias("_r")).select("_r.*")
