"""Queries without a SQL counterpart: seeded simulation, bootstrap, special functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tremorloom.functions import geo
from tremorloom.functions.region import SphericalPolygon
from tremorloom.operators import features as feats
from tremorloom.operators import particles, scoring, simulate
from tremorloom.plans.point_process import BETA, DAYS, LAST, M0, P, POLYGON, _forecast, cat, grid
from tremorloom.plans.registry import query


#: The unit of length is a degree at the equator, as in the planar queries.
REGION = SphericalPolygon(POLYGON, 180.0 / np.pi)
SIMULATIONS = 10_000


def last_week(spark, sf_dir):
    age = (((LAST + 1) * 86_400_000_000 - F.col("us")) / 86_400_000_000).alias("age")
    return cat(spark, sf_dir).where(F.col("day") > LAST - 7).select("event_id", age, "lon", "lat", "mag")


def simulated(spark, sf_dir):
    return simulate.continuations(last_week(spark, sf_dir), P, M0, BETA, P.mu, REGION, simulations=SIMULATIONS)


def cell_of():
    return (F.floor("y") * 10 + F.floor("x")).cast("int")


@query("simulate_grid")
def simulate_grid(spark, sf_dir):
    """Expected counts and occupancy of 10,000 continuations of the last week by one day, within a polygon on the sphere."""
    return scoring.occupancy(simulated(spark, sf_dir).withColumn("cell", cell_of()), SIMULATIONS, [0.0, 1.0])


@query("simulate_rates")
def simulate_rates(spark, sf_dir):
    """The day's rate of every cell with its exact background in place of simulated roots."""
    background = feats.background(cat(spark, sf_dir), grid(spark), DAYS, 10.0).select("cell", F.col("rate").alias("mass"))
    return simulate.expected_rates(simulated(spark, sf_dir), background, cell_of(), SIMULATIONS)


@query("poisson_counts")
def poisson_counts(spark, sf_dir):
    """Counts by catalogue of a homogeneous forecast with as many events as the last week had a day in the polygon."""
    week = last_week(spark, sf_dir).where(geo.in_polygon(F.col("lon"), F.col("lat"), POLYGON)).count()
    found = simulate.roots(spark, week / 7 / REGION.area, M0, BETA, REGION, simulations=1000, seed=9)
    return scoring.count_quantiles(found.groupBy("catalog").agg(F.count("*").alias("n")), spark.range(1000).withColumnRenamed("id", "catalog"), "catalog")


@query("block_bootstrap")
def block_bootstrap(spark, sf_dir):
    """Intervals of the gain per event over blocks of a week and of three days."""
    f = _forecast(spark, sf_dir).groupBy("day").agg(F.sum(F.col("n") * F.log(F.col("rate") / F.col("uniform"))).alias("gain"), F.sum("n").alias("events"))
    return scoring.block_bootstrap(f.withColumn("all", F.lit(1)), ["all"], [3.0, 7.0], 500).drop("all")


@query("particle_assimilation")
def particle_assimilation(spark, sf_dir):
    """Eight particles of every region over all cells of the grid, driven by the region's events in their cells."""
    events = cat(spark, sf_dir).select("region", "day", F.col("us").alias("order"), "event_id", F.col("mag").alias("magnitude"), F.lit(0.8).alias("probability"), F.col("cell").alias("section"), F.lit(0.7).alias("weight"))
    grid = spark.range(800).select(F.floor(F.col("id") / 100).alias("particle"), (F.col("id") % 100).cast("int").alias("section"), F.sin("id").alias("margin"))
    states = events.select("region").distinct().crossJoin(F.broadcast(grid))  # eight particles by a fixed grid
    return particles.assimilate_regions(states, events, np.linspace(-0.01, 0.01, 100), 0.2, 0.02, 0.75, 0.0)
