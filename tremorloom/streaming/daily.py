"""Structured Streaming form of the daily state: windowed counts with a watermark, and keyed state carried day by day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_counts(events: DataFrame, delay: str = "7 days", slide: str | None = None, length: str = "1 day") -> DataFrame:
    """Events by region and day (or sliding window); a window closes when the watermark, its settling delay, has passed."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def carried_state(days: DataFrame, half_life: float) -> DataFrame:
    """(key, day, state): the decayed sum before each day, kept in the state store. days: (key string, day int, n double).

    Days of a key must arrive in order, as closed windows do; a day at or before the last one seen is refused as late.
    """
    r = 0.5 ** (1.0 / half_life)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, value = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(frames)).sort_values("day")
        out = []
        for day, n in zip(rows["day"], rows["n"], strict=True):
            if last is not None and day <= last:
                continue
            if last is not None:
                value *= r ** (day - last - 1)
            out.append((key[0], int(day), value))
            value, last = value * r + n, int(day)
        state.update((last, value))
        yield pd.DataFrame(out, columns=["key", "day", "state"])

    return days.groupBy("key").applyInPandasWithState(advance, "key string, day int, state double", "last int, value double", "append", GroupStateTimeout.NoTimeout)


def append_once(target: str, keys: list[str]):
    """A foreachBatch sink that appends rows whose key is not stored yet, so a replayed batch adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(target)
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            batch.dropDuplicates(keys).write.parquet(target)
            return
        batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").write.mode("append").parquet(target)

    return write
