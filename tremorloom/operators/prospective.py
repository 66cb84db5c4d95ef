"""Day-ahead work: a stored state carried on, the next day's forecast from it, its artefacts, and scores of what came.

A forecast uses the state before its day alone. Totals are conserved and checked; missing rates, artefacts or states are errors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorloom.functions import kernels, special
from tremorloom.operators import causal, forecast, replay, traces
from tremorloom.session import cut


def shared_events(cat: DataFrame, p: kernels.Parameters, reference: float, since_day: int, tolerance: float | None = None) -> DataFrame:
    """(event_id, day, cell, magnitude, rate, share) of the events from a day on: their own rates and the background's share.

    Appended days meet the history once; earlier events are sources only.
    """
    rates = causal.incremental_intensity(cat, since_day, p, reference, tolerance=tolerance)
    rate = p.mu + F.col("triggered")
    rows = cat.where(F.col("day") >= since_day).select("event_id", "day", "cell", F.col("mag").alias("magnitude"))
    return rows.join(rates, "event_id").select("event_id", "day", "cell", "magnitude", rate.alias("rate"), (p.mu / rate).alias("share"))


def carried(state: DataFrame, expected: DataFrame, events: DataFrame, placed: DataFrame, first: int, end: int, clock: replay.Clock, tail: replay.Tail, half_life: float, scale: float = 1.0) -> DataFrame:
    """The state (branch, section, age, exposure, roots) before end, from the stored state before first and the days between."""
    begun = state.select(F.lit(0).alias("member"), "branch", "section", "age", "exposure", "roots")
    found = replay.states(expected, events, placed, first, end, clock, tail, half_life, scale, begun)
    return found.where(F.col("day") == end).select("branch", "section", "age", "exposure", "roots")


def valid_state(state: DataFrame, expected: DataFrame) -> DataFrame:
    """state, if it has each expected section once, with finite values that are not negative; else the query fails."""
    once = state.groupBy("branch", "section").agg(F.count("*").alias("n"))
    whole = expected.select("branch", "section").join(once, ["branch", "section"], "full")
    bad = F.col("n").isNull() | (F.col("n") != 1)
    known = expected.select("branch", "section", F.lit(True).alias("known"))
    flagged = whole.join(known, ["branch", "section"], "left").where(bad | F.col("known").isNull()).agg(F.count("*").alias("odd"))
    values = F.lit(True)
    for c in ("age", "exposure", "roots"):
        values &= F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    sections, broken = (F.raise_error(F.lit(t)).cast("double") for t in ("the state's sections are not the expected ones", "the state has values out of range"))
    checked = state.join(F.broadcast(flagged))  # one number
    return checked.withColumn("age", F.when(F.col("odd") > 0, sections).when(~values, broken).otherwise(F.col("age"))).drop("odd")


def background_forecast(state: DataFrame, graph: DataFrame, geometry: DataFrame, cells: DataFrame, day: int, clock: replay.Clock, frailty: replay.Frailty, branches: int = 1, cap: float = 4.0) -> DataFrame:
    """(cell, mass, area, score, mixed): the day's background before any of its events, from the state before it."""
    rows = state.select(F.lit(0).cast("long").alias("member"), "branch", "section", F.lit(day).alias("day"), "age", "exposure", "roots")
    days = rows.select("day").distinct()
    scores = replay.section_scores(rows, graph, days, clock, frailty)
    return replay.adjusted_cells(scores, geometry, cells, days, branches, clock.consensus, frailty.fraction, 1.0, cap).select("cell", "mass", "area", "score", "mixed")


def artefacts(base: DataFrame, adjusted: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(cell, baseline, challenger, log_ratio): a base forecast (cell, rate) and the same with the adjusted background.

    The background is replaced cell by cell, so both have the same total, which is checked. Cells without a base rate are an error;
    the log ratio is 0 where a rate is not positive.
    """
    met = forecast.rate_of(adjusted.select("cell", "mass", "mixed"), base, ["cell"], "baseline")
    both = met.withColumn("challenger", F.col("baseline") + F.col("mixed") - F.col("mass")).withColumn("all", F.lit(1))
    checked = forecast.checked_total(both, ["all"], "baseline", "challenger", tolerance)  # a row a cell of one day
    valid = (F.col("baseline") > 0) & (F.col("challenger") > 0)
    return checked.select("cell", "baseline", "challenger", F.when(valid, F.log(F.col("challenger") / F.when(valid, F.col("baseline")))).otherwise(0.0).alias("log_ratio"))


def scored_events(events: DataFrame, adjusted: DataFrame) -> DataFrame:
    """(event_id, cell, rate, challenger, gain) of a day's events (event_id, cell, rate): own rates plus the background's change by area."""
    added = adjusted.select("cell", ((F.col("mixed") - F.col("mass")) / F.col("area")).alias("rate"))
    met = forecast.rate_of(events.withColumnRenamed("rate", "base"), added, ["cell"], "added")
    rated = met.select("event_id", "cell", F.col("base").alias("rate"), (F.col("base") + F.col("added")).alias("challenger"))
    return rated.withColumn("gain", kernels.information_gain(F.col("challenger"), F.col("rate")))


def particle_backgrounds(geometry: DataFrame, states: DataFrame, cells: DataFrame, events: DataFrame, sensitivity: float) -> DataFrame:
    """(particle, event_id, adjusted): each particle's background at the events' cells, tilted by its margins; totals stay.

    geometry: (point, section, p) of the cells; states: (particle, section, margin); cells: (cell, mass). Cells off all sections
    have margin 0.
    """
    margins = traces.projected_states(geometry, states).withColumnRenamed("point", "cell")
    particles = states.select("particle").distinct()
    spine = cells.join(F.broadcast(particles)).join(margins, ["particle", "cell"], "left").fillna(0.0, ["margin"])
    tilted = forecast.softmax_tilt(spine, ["particle"], "mass", "margin", sensitivity)
    return events.select("event_id", "cell").join(tilted, "cell").select("particle", "event_id", "adjusted")


def root_mass(events: DataFrame, placed: DataFrame) -> DataFrame:
    """(day, branch, section, mass) of the events' background shares by section; section is null for what is off all of a branch's.

    Every branch's rows of a day add up to the day's whole share; chances above 1 are an error.
    """
    branches = placed.select("branch").distinct()
    on = events.join(placed, "event_id").groupBy("day", "branch", "section").agg(F.sum(F.col("share") * F.col("p")).alias("mass"))
    whole = events.groupBy("day").agg(F.sum("share").alias("whole")).join(F.broadcast(branches))
    sums = on.groupBy("day", "branch").agg(F.sum("mass").alias("on"))
    made = F.raise_error(F.concat(F.lit("sections have more than the share of day "), F.col("day").cast("string"))).cast("double")
    left = F.col("whole") - F.coalesce("on", F.lit(0.0))
    off = whole.join(sums, ["day", "branch"], "left").select("day", "branch", F.when(left < -1e-9, made).otherwise(F.greatest(left, F.lit(0.0))).alias("mass"))
    return on.unionByName(off.withColumn("section", F.lit(None).cast(on.schema["section"].dataType)))


def slice_of(events: DataFrame, key: str, at: str, start: Column, end: Column) -> DataFrame:
    """Events from start to before end, in a period that no id is twice in; a repeated id is an error."""
    kept = events.where((F.col(at) >= start) & (F.col(at) < end))
    twice = F.raise_error(F.concat(F.lit("repeated id "), F.col(key).cast("string"))).cast("long")
    counts = kept.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    met = kept.join(counts, F.col(key) == F.col("_k"))
    return met.where(F.when(F.col("_n") > 1, twice).otherwise(F.lit(1)) == 1).drop("_k", "_n")


def mean_log_likelihoods(terms: DataFrame) -> DataFrame:
    """One row of causal.target_terms: targets, and the mean log intensity less the interval's expected number, at the place and over the plane."""
    return terms.agg(F.count("*").alias("targets"), F.avg(F.log("point") - F.col("corrected")).alias("point_ll"), F.avg(F.log("temporal") - F.col("corrected")).alias("temporal_ll"), F.avg(F.log("point") - F.log("temporal")).alias("spatial_ll"))


def expected_direct(mag: Column, reference: float, p: kernels.Parameters) -> Column:
    """Expected direct offspring of an event over all time and the plane."""
    time = float(special.temporal_integral(np.zeros(1), np.array([1e12]), p)[0])
    return kernels.productivity(mag, reference, p) * kernels.spatial_mass(mag, reference, p) * time


def publication_deadline(issued: Column, minutes: int) -> Column:
    """Midnight of the issue's day plus the minutes that publication may take."""
    return F.date_trunc("day", issued) + F.make_dt_interval(mins=F.lit(minutes))


def invalidation_threshold(days: int, share: float) -> int:
    """Missed days that make a period of so many days invalid: more than the share of them."""
    return math.floor(days * share) + 1


def forecast_window(state_at: Column) -> Column:
    """(start, end) of the day that follows a state's midnight; a state at any other time is an error."""
    midnight = F.date_trunc("day", state_at)
    odd = F.raise_error(F.lit("a state ends at midnight")).cast("timestamp")
    start = F.when(midnight == state_at, midnight).otherwise(odd)
    return F.struct(start.alias("start"), (start + F.expr("interval 1 day")).alias("end"))


def both_artefacts(artefacts: DataFrame, runs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """runs (run) with the paths (run, name, path) of two artefacts; a run that lacks one, or has it twice, is an error."""
    paths = [F.collect_list(F.when(F.col("name") == n, F.col("path"))).alias(n) for n in names]  # a run has a few artefacts
    met = runs.join(artefacts.groupBy("run").agg(*paths), "run", "left")
    lacks = F.raise_error(F.concat(F.lit("not one artefact of each kind for run "), F.col("run").cast("string")))
    return met.select("run", *[F.when(F.size(n) == 1, F.col(n)[0]).otherwise(lacks).alias(n) for n in names])


def transferred(states: DataFrame, source: str, target: str, at: Column) -> DataFrame:
    """Rows (protocol, branch, section, as_of, ...) that give a new protocol the newest state of another at or before a time."""
    known = states.where((F.col("protocol") == source) & (F.col("as_of") <= at))
    newest = known.groupBy("branch", "section").agg(F.max_by(F.struct(*[c for c in states.columns if c not in ("protocol", "branch", "section")]), "as_of").alias("s"))
    fresh = newest.select(F.lit(target).alias("protocol"), "branch", "section", "s.*").select(*states.columns)
    return cut(fresh).join(states.where(F.col("protocol") == target).select("branch", "section"), ["branch", "section"], "left_anti").select(*states.columns)
