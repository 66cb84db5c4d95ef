"""Leakage-free features: trailing counts on a dense (cell, day) spine that see strictly earlier days only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.functions import kernels
from tremorloom.operators import grid as grids


def spine(cat: DataFrame, grid: DataFrame) -> DataFrame:
    """(cell, day, n): every cell on every day from the first to the last, zero days included."""
    span = cat.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))  # two numbers give the days
    counts = cat.groupBy("cell", "day").agg(F.count("*").alias("n"))
    dense = grid.select("cell").join(F.broadcast(days))
    return dense.join(counts, ["cell", "day"], "left").select("cell", "day", F.coalesce("n", F.lit(0)).alias("n"))


def trailing(dense: DataFrame, windows: tuple[int, ...] = (3, 7, 30, 90)) -> DataFrame:
    """dense with n_w for each window: events of the w days before the day itself. All frames share one sort."""
    w = Window.partitionBy("cell").orderBy("day")
    return dense.select("*", *[F.coalesce(F.sum("n").over(w.rangeBetween(-d, -1)), F.lit(0)).alias(f"n_{d}") for d in windows])


def recency(dense: DataFrame, cap: int) -> DataFrame:
    """dense with days since the last earlier event, capped; the cap where there was none."""
    before = Window.partitionBy("cell").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("n") > 0, F.col("day")), ignorenulls=True).over(before)
    return dense.withColumn("recency", F.coalesce(F.least(F.col("day") - last, F.lit(cap)), F.lit(cap)))


def background(cat: DataFrame, grid: DataFrame, days: int, prior_days: float) -> DataFrame:
    """(cell, rate): additively smoothed daily rates, towards the mean over cells."""
    counts = grid.select("cell").join(cat.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))
    mean = counts.agg((F.avg("n") / days).alias("g"))  # one row
    return counts.crossJoin(F.broadcast(mean)).select("cell", ((F.col("n") + F.col("g") * prior_days) / (days + prior_days)).alias("rate"))


def snapshot(cat: DataFrame, grid: DataFrame, days: int, prior_days: float = 10.0, cap: int = 365, floor_share: float = 0.1) -> DataFrame:
    """The features of every cell-day: trailing counts, log excesses, acceleration, recency and the neighbours' forms."""
    rates = background(cat, grid, days, prior_days)
    floor = rates.agg((F.avg("rate") * floor_share).alias("floor"))  # one row
    rows = recency(trailing(spine(cat, grid)), cap).join(F.broadcast(rates), "cell").crossJoin(F.broadcast(floor))
    base = F.greatest("rate", "floor")
    local = rows.select(
        "cell",
        "day",
        "n",
        *[f"n_{d}" for d in (3, 7, 30, 90)],
        "recency",
        kernels.log_rate_excess(F.col("n_7"), 7.0, F.col("rate"), F.col("floor")).alias("excess_7"),
        kernels.log_rate_excess(F.col("n_30"), 30.0, F.col("rate"), F.col("floor")).alias("excess_30"),
        kernels.log_rate_ratio(F.col("n_7"), 7.0, F.col("n_30"), 30.0, base).alias("acceleration"),
    )
    near = grids.neighbour_values(local, grid, "n_7", ["day"])
    quiet = grids.neighbour_values(local.select("day", "cell", "recency"), grid, "recency", ["day"], how="min", missing=float(cap))
    return local.join(near, ["day", "cell"], "left").join(quiet, ["day", "cell"], "left").fillna(0, ["neighbour_n_7"]).fillna(float(cap), ["neighbour_recency"])


#: The transformed features of a cell-day, in the order of a model's weights.
FEATURES = [
    *[f"log_{who}_{d}" for d in (3, 7, 30, 90) for who in ("cell", "near")],
    "cell_excess_30",
    "near_excess_30",
    "cell_acceleration",
    "near_acceleration",
    "log_cell_recency",
    "log_near_recency",
    "log_background",
]


def matrix(cat: DataFrame, grid: DataFrame, days: int, prior_days: float = 10.0, cap: int = 365, floor_share: float = 0.1) -> DataFrame:
    """(cell, day, n, rate, FEATURES) of every cell-day: the cell's and its neighbours' counts, excesses, accelerations and recencies.

    Neighbours' values come from one join and one grouping. A cell without neighbours has their counts 0 and their recency at
    the cap, and so has one at the border for the neighbours that it lacks.
    """
    rates = background(cat, grid, days, prior_days)
    floor = rates.agg(F.greatest(F.avg("rate") * floor_share, F.lit(kernels.TINY)).alias("floor"))  # one row
    counts = [f"n_{d}" for d in (3, 7, 30, 90)]
    local = recency(trailing(spine(cat, grid)), cap).join(rates, "cell")
    met = local.select(F.col("cell").alias("neighbour"), "day", *counts, "rate", "recency").join(grids.edges(grid), "neighbour")
    near = met.groupBy("cell", "day").agg(*[F.sum(c).alias(f"near_{c}") for c in [*counts, "rate"]], F.min("recency").alias("least"), F.count("*").alias("degree"))
    rows = local.join(near, ["cell", "day"], "left").crossJoin(F.broadcast(floor)).fillna(0, [f"near_{c}" for c in [*counts, "rate"]])
    quiet = F.when(F.coalesce("degree", F.lit(0)) < 8, F.least(F.coalesce("least", F.lit(cap)), F.lit(cap))).otherwise(F.col("least"))
    floored = {who: F.greatest(rate, "floor") for who, rate in (("cell", "rate"), ("near", "near_rate"))}
    values = []
    for c in counts:
        values += [F.log1p(c), F.log1p(f"near_{c}")]
    values += [kernels.log_rate_excess(F.col(c), 30.0, F.col(rate), F.col("floor")) for c, rate in (("n_30", "rate"), ("near_n_30", "near_rate"))]
    values += [kernels.log_rate_ratio(F.col(a), 7.0, F.col(b), 30.0, floored[who]) for who, a, b in (("cell", "n_7", "n_30"), ("near", "near_n_7", "near_n_30"))]
    values += [F.log1p("recency"), F.log1p(quiet), F.log("rate")]
    return rows.select("cell", "day", "n", "rate", *[v.alias(name) for v, name in zip(values, FEATURES, strict=True)])
