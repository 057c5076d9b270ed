"""Streams: change detection by key, incremental appends with deduplication, windowed event totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def changes(df: DataFrame, key: str, stamp: str, order: str) -> DataFrame:
    """Batch form: baseline at a key's first row, then whether the stamp differs from the one before."""
    before = F.lag(stamp).over(Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    kind = F.when(first, "baseline").when(before.eqNullSafe(F.col(stamp)), "same").otherwise("changed")
    return df.select(key, order, stamp, kind.alias("change"))


def change_stream(stream: DataFrame, key: str, stamp: str) -> DataFrame:
    """Streaming form of (key string, stamp bigint): state is the last stamp of each key; only changes come out."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for batch in batches:
            for value in batch.sort_values(stamp)[stamp]:
                if last is not None and value != last:
                    out.append((name[0], int(value)))
                last = int(value)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "stamp"])

    return stream.groupBy(key).applyInPandasWithState(step, "key string, stamp bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_totals(events: DataFrame, time: str, by: list[str], value: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each window; on a stream, rows later than the watermark are left out and closed windows forgotten."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by)
        .agg(F.count("*").alias("events"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), *by, "events", "total")
    )


def append_once(stream: DataFrame, key: str, path: str, checkpoint: str):
    """Appends each key's first row to Parquet in batches of a file each; a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed(stream: DataFrame, generation: Column, install, checkpoint: str, every: str = "30 seconds"):
    """Calls install(generation) whenever a batch brings one that differs from the last."""
    seen: dict[str, str] = {}

    def step(batch: DataFrame, _: int) -> None:
        row = batch.agg(F.max(generation).alias("g")).first()
        if row["g"] is not None and seen.get("g") != row["g"]:
            seen["g"] = row["g"]
            install(row["g"])

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
