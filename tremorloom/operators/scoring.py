"""Scores: ratio-of-sums gains, strata, daily vectors with zero days, summaries and the stationary block bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def igpe(gain: Column, count: Column) -> Column:
    """Sum of gains over events; null without events."""
    return F.sum(gain) / F.nullif(F.sum(count), F.lit(0))


def daily_vectors(gains: DataFrame, day: str, gain: str, first_day: int | Column, last_day: int | Column) -> DataFrame:
    """(day, gain, events) with a row for every day of the period."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    days = gains.sparkSession.range(1).select(F.explode(F.sequence(as_column(first_day), as_column(last_day))).alias(day))
    sums = gains.groupBy(day).agg(F.sum(gain).alias("gain"), F.count(gain).alias("events"))
    return days.join(sums, day, "left").select(day, F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("events", F.lit(0)).alias("events"))


def summary(daily: DataFrame, keys: list[str]) -> DataFrame:
    agg = [F.sum("events").alias("events"), F.sum("gain").alias("total"), igpe(F.col("gain"), F.col("events")).alias("igpe"), F.count_if(F.expr("gain > 0")).alias("ahead"), F.count_if(F.expr("gain < 0")).alias("behind")]
    return daily.groupBy(*keys).agg(*agg)


def robust(gains: DataFrame, year: Column, gain: str, keys: list[str]) -> DataFrame:
    """Mean over years of the yearly mean, less its population deviation over years."""
    yearly = gains.groupBy(*keys, year.alias("_y")).agg(F.avg(gain).alias("m"))
    return yearly.groupBy(*keys).agg((F.avg("m") - F.stddev_pop("m")).alias("robust"), F.min("m").alias("worst"), F.count_if(F.expr("m > 0")).alias("positive_years"))


def gain_summary(gains: DataFrame, keys: list[str], gain: str = "gain") -> DataFrame:
    """(keys, events, mean, factor, total, positive_share) of gains by event; factor is the mean's exponential."""
    mean = F.avg(gain)
    return gains.groupBy(*keys).agg(F.count(gain).alias("events"), mean.alias("mean"), F.exp(mean).alias("factor"), F.sum(gain).alias("total"), F.avg((F.col(gain) > 0).cast("double")).alias("positive_share"))


def paired(left: DataFrame, right: DataFrame, event: str = "event_id", gain: str = "gain") -> DataFrame:
    """left with gain replaced by its difference to right's; an event that one side lacks, or has twice, is an error."""
    a, b = left.groupBy(event).agg(F.count("*").alias("_l"), F.first(gain).alias("_x")), right.groupBy(event).agg(F.count("*").alias("_r"), F.first(gain).alias("_y"))
    unpaired = F.raise_error(F.concat(F.lit("not one pair of event "), F.col(event).cast("string"))).cast("double")
    difference = a.join(b, event, "full").select(event, F.when((F.col("_l") == 1) & (F.col("_r") == 1), F.col("_x") - F.col("_y")).otherwise(unpaired).alias(gain))
    return left.drop(gain).join(difference, event, "right")


def dense_days(gains: DataFrame, keys: list[str], day: str = "day", gain: str = "gain", span: tuple[int, int] | None = None) -> DataFrame:
    """(keys, day, gain, events) of every calendar day from a stratum's first to its last, or of the span for all strata."""
    daily = gains.groupBy(*keys, F.col(day).alias("day")).agg(F.sum(gain).alias("gain"), F.count(gain).alias("events"))
    ends = daily.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = F.sequence("a", "b") if span is None else F.sequence(F.lit(span[0]), F.lit(span[1]))
    spine = ends.select(*keys, F.explode(days).alias("day"))
    return spine.join(daily, [*keys, "day"], "left").fillna(0, ["gain", "events"])


def rejections(tests: DataFrame, level: float) -> DataFrame:
    """tests (name, quantiles array<double>) with rejected: two one-sided quantiles by either below the level, a single one by both tails.

    Null quantiles reject nothing.
    """
    known = F.filter("quantiles", lambda q: q.isNotNull())
    low = F.exists(known, lambda q: q < level)
    high = F.exists(known, lambda q: q > 1 - level)
    return tests.withColumn("rejected", F.coalesce(F.when(F.size("quantiles") > 1, low).otherwise(low | high), F.lit(False)))


def wide_days(daily: DataFrame, stratum: str, strata: list[str]) -> DataFrame:
    """(day, events_s, gain_s, ...) with a pair of columns for each named stratum, in their order, 0 where it has nothing; days ascend."""
    wide = daily.groupBy("day").pivot(stratum, strata).agg(F.sum("events").alias("events"), F.sum("gain").alias("gain"))
    columns = [F.coalesce(F.col(f"`{x}_{c}`"), F.lit(0)).alias(f"{c}_{x}") for x in strata for c in ("events", "gain")]
    return wide.select("day", *columns).orderBy("day")


#: Replicates that one task draws; the least share of them that must have events.
REPLICATES_A_TASK, VALID = 100, 0.99


def block_bootstrap(daily: DataFrame, keys: list[str], blocks: list[float], replicates: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(keys, block, replicates, valid, lower, median, upper) of the ratio of sums under the stationary bootstrap.

    daily: (keys, day, gain, events), a row a day, gathered to one row a stratum of as many numbers as there are days. Each
    replicate is seeded by its number and block, so the result does not depend on how they are dealt. A replicate without
    events counts for nothing; if they are more than one in a hundred, the query fails.
    """
    if replicates <= 0 or not 0 < level < 1 or any(b <= 1 for b in blocks):
        raise ValueError("replicates, blocks above one day and a level within 0 and 1 are needed")
    days = F.sort_array(F.collect_list(F.struct("day", F.col("gain").cast("double").alias("gain"), F.col("events").cast("double").alias("events"))))
    series = daily.groupBy(*keys).agg(days.alias("_series")).select(*keys, F.col("_series.gain").alias("_g"), F.col("_series.events").alias("_e"))
    tasks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // REPLICATES_A_TASK)))
    work = series.withColumn("block", F.explode(F.array(*[F.lit(float(b)) for b in blocks]))).withColumn("piece", tasks).repartition(*keys, "block", "piece")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                g, e = np.asarray(row["_g"], float), np.asarray(row["_e"], float)
                n, out = len(g), []
                ids = range(row["piece"] * REPLICATES_A_TASK, min(replicates, (row["piece"] + 1) * REPLICATES_A_TASK))
                for i in ids:
                    rng = np.random.default_rng([seed, int(row["block"] * 1000), i])
                    fresh = rng.random(n) < 1 / row["block"]
                    fresh[0] = True
                    start = np.flatnonzero(fresh)
                    begin = rng.integers(0, n, len(start))
                    run = np.cumsum(fresh) - 1
                    at = (begin[run] + np.arange(n) - start[run]) % n
                    total = e[at].sum()
                    out.append(g[at].sum() / total if total else None)
                yield pd.DataFrame({**{k: [row[k]] * len(out) for k in keys}, "block": row["block"], "igpe": pd.array(out, "Float64")})

    schema = ", ".join([*(f"`{k}` {daily.schema[k].dataType.simpleString()}" for k in keys), "block double, igpe double"])
    drawn = work.mapInPandas(draw, schema)
    tail, few = (1 - level) / 2, F.raise_error(F.lit("too many replicates without events")).cast("double")
    valid = F.count("igpe")
    guarded = lambda q: F.when(valid >= VALID * F.count("*"), F.percentile("igpe", F.lit(q))).otherwise(few)
    return drawn.groupBy(*keys, "block").agg(F.count("*").alias("replicates"), valid.alias("valid"), guarded(tail).alias("lower"), guarded(0.5).alias("median"), guarded(1 - tail).alias("upper"))


def occupancy(simulated: DataFrame, simulations: int, thresholds: list[float]) -> DataFrame:
    """Per threshold and cell: expected events and the share of simulations with any."""
    levels = simulated.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("mag >= threshold")
    per = levels.groupBy("threshold", "cell", "catalog").agg(F.count("*").alias("n"))
    return per.groupBy("threshold", "cell").agg((F.sum("n") / simulations).alias("expected"), (F.count("*") / simulations).alias("probability"))


def count_quantiles(counts: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Summary of counts per catalogue, where catalogues without events count as zero."""
    filled = members.join(counts, key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return filled.agg(F.count("*").alias("catalogs"), F.count_if(F.expr("n = 0")).alias("empty"), F.avg("n").alias("mean"), F.var_pop("n").alias("variance"), F.percentile("n", F.lit(0.025)).alias("q025"), F.percentile("n", F.lit(0.5)).alias("q500"), F.percentile("n", F.lit(0.975)).alias("q975"))
