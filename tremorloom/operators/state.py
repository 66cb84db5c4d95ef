"""Day-by-day state: closed forms over windows where they are stable, scans along sorted rows where they are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.operators.scan import Step, scanned


#: Half-lives in a block of days: powers of two that far apart stay well inside a double.
BLOCK = 300


def decayed_sum(rows: DataFrame, keys: list[str], day: str, value: Column, half_life: float, name: str) -> DataFrame:
    """rows with the state before the day: S <- r S + value with r = 2 ** (-1 / half_life), for series of any length.

    Within a block of BLOCK half-lives it is a running sum of scaled terms; the block before is carried in whole. What is
    older still has lost a factor of 2 ** BLOCK, which no double shows.
    """
    r = F.lit(0.5 ** (1.0 / half_life))
    days = max(1, int(BLOCK * half_life))
    since = F.col(day) - F.min(day).over(Window.partitionBy(*keys))
    placed = rows.withColumns({"_v": value.cast("double"), "_block": F.floor(since / days), "_t": since % days})
    earlier = Window.partitionBy(*keys, "_block").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(F.col("_v") * F.pow(r, -F.col("_t"))).over(earlier) * F.pow(r, F.col("_t") - 1), F.lit(0.0))
    last = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    carried = F.coalesce(F.sum(F.col("_v") * F.pow(r, days - 1 - F.col("_t"))).over(last) * F.pow(r, F.col("_t")), F.lit(0.0))
    return placed.withColumns({"_within": within, "_carried": carried}).withColumn(name, F.col("_within") + F.col("_carried")).drop("_v", "_block", "_t", "_within", "_carried")


def hazard_age(rows: DataFrame, keys: list[str], day: str, hazard: float, observed: str, start: float = 0.0) -> DataFrame:
    """Age before each day, as `state`: A <- (A + hazard) exp(-observed)."""
    kept = F.exp(-F.col(observed))
    return scanned(rows.select(*keys, day, observed), keys, day, {"state": Step(kept, hazard * kept, F.lit(float(start)))}).drop(observed)


def cusum(rows: DataFrame, keys: list[str], day: str, observed: Column, expected: Column, decay: float) -> DataFrame:
    """Compensated sum before each day, as `state`: S <- max(0, decay S + observed - expected); and its `variance`: V <- decay^2 V + expected."""
    slim = rows.select(*keys, day, observed.alias("_o"), expected.alias("_e"))
    steps = {"state": Step(F.lit(decay), F.col("_o") - F.col("_e"), F.lit(0.0), 0.0), "variance": Step(F.lit(decay * decay), F.col("_e"), F.lit(0.0))}
    return scanned(slim, keys, day, steps).drop("_o", "_e")


def criticality(rows: DataFrame, keys: list[str], day: str, loading: Column, release: Column, transfer: Column, elapsed: float = 1.0, start: float = 0.0) -> DataFrame:
    """Margin before each day, as `state`: M <- M + loading * elapsed - release + transfer. A negative release is an error."""
    below = F.raise_error(F.lit("a release must not be negative")).cast("double")
    step = loading * elapsed - F.when(release < 0, below).otherwise(release) + transfer
    return scanned(rows.select(*keys, day, step.alias("_m")), keys, day, {"state": Step(F.lit(1.0), F.col("_m"), F.lit(float(start)))}).drop("_m")


def runs(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Islands of consecutive days: (keys, first, last, length)."""
    days = rows.select(*keys, day).distinct()
    island = F.col(day) - F.row_number().over(Window.partitionBy(*keys).orderBy(day))
    return days.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("length")).drop("_i")
