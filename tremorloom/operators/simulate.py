"""Seeded Monte Carlo continuations of a catalogue whose work follows the offspring, not events times simulations.

Offspring of an event over all simulations are one Poisson process on a line as long as the simulations times the event's mean; a
place on that line names the simulation. The line is cut into pieces of PIECE expected offspring, so an event that bears most
of them is shared by many tasks. What is drawn depends on the seed, the event, the piece and the number of the draw alone:
results are the same however rows are dealt, and the first simulations stay when more are asked for (roots too).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorloom.functions.kernels import Parameters
from tremorloom.functions.region import Square, SphericalPolygon
from tremorloom.functions.special import temporal_integral

#: Expected offspring of a piece of work; parents that a task takes at a time; delays that the table spans, in tau.
PIECE, SIDE, SPAN = 64.0, 1 << 16, 50.0
SCHEMA = "catalog long, t double, x double, y double, mag double, is_root boolean"

Region = Square | SphericalPolygon


@lru_cache(maxsize=8)
def _delay_table(p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """Delays and the kernel's mass up to each, the same for every batch."""
    grid = np.geomspace(p.c, SPAN * p.tau + p.c, 8192) - p.c
    return grid, np.concatenate(([0.0], np.cumsum(temporal_integral(grid[:-1], grid[1:], p))))


def _mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _keyed(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(key + _mixed(number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))


def _uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the draw alone."""
    return ((_keyed(key, np.full(len(key), draw, np.uint64)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _arrivals(key: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, place) of the arrivals of unit Poisson processes on lines of these lengths, by exponential waiting times."""
    at = np.flatnonzero(length > 0)
    wait = np.zeros(len(at))
    rows, numbers, places, j = [], [], [], 0
    while len(at):
        wait = wait - np.log(_uniform(key[at], 16 + j))
        inside = wait <= length[at]
        at, wait = at[inside], wait[inside]
        rows.append(at)
        numbers.append(np.full(len(at), j))
        places.append(wait)
        j += 1
    return (np.concatenate(rows), np.concatenate(numbers), np.concatenate(places)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def expected_offspring(t: np.ndarray, mag: np.ndarray, p: Parameters, reference: float, days: float) -> np.ndarray:
    """Mean number of direct offspring within the horizon of events at times t, negative for the past."""
    grid, mass = _delay_table(p)
    scale = p.d * np.exp(p.gamma * (mag - reference))
    within = np.interp(days - t, grid, mass) - np.interp(np.maximum(0.0, -t), grid, mass)
    return p.k0 * np.exp(p.a * (mag - reference)) * math.pi / p.rho * scale**-p.rho * within


def offspring_ratio(p: Parameters, beta: float, days: float) -> float:
    """Mean direct offspring within the horizon of an event at its begin, over exponential magnitudes."""
    if beta <= p.productivity_exponent:
        return math.inf
    grid, mass = _delay_table(p)
    return p.k0 * math.pi / p.rho * p.d**-p.rho * float(np.interp(days, grid, mass)) * beta / (beta - p.productivity_exponent)


def _subcritical(p: Parameters, beta: float, days: float, generations: int | None) -> None:
    if generations is None and (n := offspring_ratio(p, beta, days)) >= 1:
        raise ValueError(f"continuations need not die out: {n:.3g} offspring an event; bound the generations or shorten the horizon")


def _born(parents: np.ndarray, key: np.ndarray, p: Parameters, reference: float, beta: float, days: float, region: Region) -> np.ndarray:
    """A child (t, x, y, magnitude) of each parent, for each key."""
    grid, mass = _delay_table(p)
    low, high = (np.interp(v, grid, mass) for v in (np.maximum(0.0, -parents[:, 0]), days - parents[:, 0]))
    t = parents[:, 0] + np.interp(low + _uniform(key, 0) * (high - low), mass, grid)
    r = np.sqrt(p.d * np.exp(p.gamma * (parents[:, 3] - reference)) * (_uniform(key, 1) ** (-1 / p.rho) - 1))
    x, y = region.moved(parents[:, 1], parents[:, 2], r, _uniform(key, 2) * 2 * np.pi)
    return np.column_stack((t, x, y, reference - np.log(_uniform(key, 3)) / beta))


def _generations(catalog: np.ndarray, born: np.ndarray, key: np.ndarray, p: Parameters, reference: float, beta: float, days: float, region: Region, generations: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """These events' descendants, generation by generation; a task holds SIDE parents of each generation at a time."""
    waiting = [(0, catalog, born, key)]
    while waiting:
        depth, catalog, parents, key = waiting.pop()
        if generations is not None and depth >= generations:
            continue
        if len(parents) > SIDE:
            waiting += [(depth, catalog[i : i + SIDE], parents[i : i + SIDE], key[i : i + SIDE]) for i in range(0, len(parents), SIDE)]
            continue
        of, number, _ = _arrivals(key, expected_offspring(parents[:, 0], parents[:, 3], p, reference, days))
        if len(of):
            key = _keyed(key[of], number)
            children = _born(parents[of], key, p, reference, beta, days, region)
            yield catalog[of], children
            waiting.append((depth + 1, catalog[of], children, key))


def _frame(catalog: np.ndarray, rows: np.ndarray, root: bool, region: Region) -> pd.DataFrame:
    inside = region.inside(rows[:, 1], rows[:, 2])
    rows = rows[inside]
    return pd.DataFrame({"catalog": catalog[inside].astype(np.int64), "t": rows[:, 0], "x": rows[:, 1], "y": rows[:, 2], "mag": rows[:, 3], "is_root": root})


def roots(spark: SparkSession, rate: float, reference: float, beta: float, region: Region, days: float = 1.0, simulations: int = 1000, seed: int = 1, p: Parameters | None = None, generations: int | None = None) -> DataFrame:
    """Uniform Poisson events of `rate` a unit of area and day in the region; with parameters their descendants too.

    Without parameters this is the homogeneous reference forecast.
    """
    mean = rate * region.area * days
    if p is not None:
        _subcritical(p, beta, days, generations)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sims = batch["id"].to_numpy()
            key = _keyed(np.full(len(sims), seed, np.uint64), sims)
            of, number, place = _arrivals(_keyed(key, np.full(len(sims), 7)), np.full(len(sims), mean))
            key = _keyed(key[of], number)
            x, y = region.draw(key, _uniform)
            rows = np.column_stack((place / mean * days if mean else place, x, y, reference - np.log(_uniform(key, 3)) / beta))
            yield _frame(sims[of], rows, True, region)
            if p is not None:
                for catalog, born in _generations(sims[of], rows, _keyed(key, np.full(len(key), 5)), p, reference, beta, days, region, generations):
                    yield _frame(catalog, born, False, region)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, simulations, 1, max(1, min(tasks, simulations))).mapInPandas(run, SCHEMA)


def continuations(history: DataFrame, p: Parameters, reference: float, beta: float, background: float, region: Region, days: float = 1.0, simulations: int = 1000, seed: int = 1, generations: int | None = None) -> DataFrame:
    """(catalog, t, x, y, mag, is_root) of the events inside the region of all simulations of a history of any size.

    history: (event_id, age in days before issue, lon, lat, mag); events with a null or a negative age bear nothing. Descendants
    that leave the region go on bearing, but are not returned. Roots are drawn in the region; generations bounds the descent.
    Parameters with which an event has one offspring or more on average within the horizon are an error, unless it is bounded.
    """
    _subcritical(p, beta, days, generations)

    @F.pandas_udf("double")
    def mean(age: pd.Series, mag: pd.Series) -> pd.Series:
        return pd.Series(expected_offspring(-age.to_numpy(), mag.to_numpy(), p, reference, days))

    def triggered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = _keyed(np.full(len(batch), seed, np.uint64), batch["event_id"].to_numpy(np.int64))
            key = _keyed(key, batch["piece"].to_numpy(np.int64))
            m = batch["mean"].to_numpy()
            begin = batch["piece"].to_numpy() * PIECE
            of, number, place = _arrivals(key, np.minimum(PIECE, m * simulations - begin))
            sims = np.minimum((begin[of] + place) / m[of], simulations - 1).astype(np.int64)
            key = _keyed(key[of], number)
            parents = np.column_stack((-batch["age"].to_numpy(), batch["lon"], batch["lat"], batch["mag"]))
            first = _born(parents[of], key, p, reference, beta, days, region)
            yield _frame(sims, first, False, region)
            more = None if generations is None else generations - 1
            for catalog, born in _generations(sims, first, key, p, reference, beta, days, region, more):
                yield _frame(catalog, born, False, region)

    spark = history.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sources = history.where("age >= 0 AND lon IS NOT NULL AND lat IS NOT NULL AND mag IS NOT NULL").select("event_id", "age", "lon", "lat", "mag", mean("age", "mag").alias("mean"))
    pieces = F.greatest(F.ceil(F.col("mean") * simulations / PIECE), F.lit(1)).cast("long") - 1
    work = sources.where("mean > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces))).repartition(tasks, "event_id", "piece")
    return work.mapInPandas(triggered, SCHEMA).unionByName(roots(spark, background, reference, beta, region, days, simulations, seed, p, generations))


def expected_rates(simulated: DataFrame, background: DataFrame, cell, simulations: int) -> DataFrame:
    """(cell, rate): the exact background of every cell (cell, mass) in place of the simulated roots, plus the mean of all others."""
    counts = simulated.where("NOT is_root").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    return background.join(counts, "cell", "left").select("cell", (F.col("mass") + F.coalesce("n", F.lit(0)) / simulations).alias("rate"))
