"""Operational state without row updates: append-only logs, idempotent inserts, latest-per-key views and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not stored yet: what an idempotent append writes."""
    return new.join(stored.select(*keys).distinct(), keys, "left_anti")


def conflicts(new: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows whose key is stored with other values; a repeated insert must find none."""
    s = stored.select(*keys, *[F.col(v).alias(f"stored_{v}") for v in values])
    differs = F.lit(False)
    for v in values:
        differs |= ~F.col(v).eqNullSafe(F.col(f"stored_{v}"))
    return new.join(s, keys).where(differs)


def folded(log: DataFrame, keys: list[str], latest: list[str], first: list[str], flags: list[str], counters: list[str], order: str) -> DataFrame:
    """State of each key: newest values, first values that are set once, flags that stay set, largest counters, attempts."""
    agg = [F.max_by(c, order).alias(c) for c in latest]
    agg += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    agg += [F.bool_or(c).alias(c) for c in flags] + [F.max(c).alias(c) for c in counters] + [F.count("*").alias("attempts")]
    return log.groupBy(*keys).agg(*agg)


def complete_days(rows: DataFrame, day: str, member: str, expected: int) -> DataFrame:
    """Days on which every one of the expected members is present."""
    return rows.groupBy(day).agg(F.count_distinct(member).alias("members")).where(F.col("members") == expected).select(day)


def trailing_streak(rows: DataFrame, keys: list[str], day: str, status: str, missed: str, done: str) -> DataFrame:
    """Missed days after the last day that is done; other statuses are skipped over."""
    last = F.max(F.when(F.col(status) == done, F.col(day))).over(Window.partitionBy(*keys))
    return rows.withColumn("_l", last).groupBy(*keys).agg(F.count_if((F.col(status) == missed) & (F.col("_l").isNull() | (F.col(day) > F.col("_l")))).alias("streak"))


def artifact_counts(runs: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Each run with the number of its artifacts, zero where there is none."""
    return runs.join(artifacts.groupBy(key).agg(F.count("*").alias("artifacts")), key, "left").withColumn("artifacts", F.coalesce("artifacts", F.lit(0)))


def on_time(rows: DataFrame, issued: str, boundary: Column, minutes: int) -> DataFrame:
    """Rows issued within the deadline after their boundary; late rows are refused, never filled in afterwards."""
    return rows.where((F.col(issued) >= boundary) & (F.col(issued) <= boundary + F.expr(f"interval {minutes} minutes")))
