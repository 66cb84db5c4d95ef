"""Queries of day-by-day replays: regional ones on the grid, and branches of sections that share cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.functions import geo, kernels, special
from tremorloom.operators import features as feats
from tremorloom.operators import causal, fields, forecast, prospective, replay
from tremorloom.operators import grid as grids
from tremorloom.plans import point_process as pp
from tremorloom.plans.registry import query
from tremorloom.session import cut

CLOCK = replay.Clock(full=2.4, exponent=0.75, mix=0.3, aperiodicity=0.5, consensus=0.25, fraction=0.6, sensitivity=0.8)
FRAILTY = replay.Frailty(overdue_weight=0.9, frailty_weight=0.7, prior=2.0, half_life=12.0, mix=0.25, floor=0.01, fraction=0.5)
PHASE = replay.Phase(short=2.0, long=9.0, floor=0.0, coherence=0.4, weight=1.5)
TAIL = replay.Tail(pp.BETA, 0.0)
FIRST, END, SCORING = pp.FIRST, pp.LAST + 1, pp.FIRST + 5
#: Share of a cell's smoothed rate that is its background; square kilometres of a unit of area.
SHARE, AREA = 0.02, 1e4


# ---------------------------------------------------------------- inputs


def cells(spark, sf_dir) -> DataFrame:
    rates = feats.background(pp.cat(spark, sf_dir), pp.grid(spark), pp.DAYS, 10.0)
    area = geo.cell_area_km2(F.floor(F.col("cell") / 10).cast("double"), 1.0) / AREA
    return rates.select("cell", (SHARE * F.col("rate")).alias("mass"), area.alias("area"))


def events(spark, sf_dir) -> DataFrame:
    c = pp.cat(spark, sf_dir)
    rates = feats.background(c, pp.grid(spark), pp.DAYS, 10.0)
    counts = c.groupBy("cell", "day").agg(F.count("*").alias("n"))
    rate = F.col("rate") + 0.1 * F.col("n")
    return c.select("event_id", "day", "cell", F.col("mag").alias("magnitude")).join(counts, ["cell", "day"]).join(rates, "cell").select("event_id", "day", "cell", "magnitude", rate.alias("rate"), (F.col("rate") / rate).alias("share"))


def regional(spark, sf_dir) -> dict[str, DataFrame]:
    """Inputs of a replay in which every cell is a section of one branch."""
    c, e = cut(cells(spark, sf_dir)), cut(events(spark, sf_dir))
    branch = F.lit(0).alias("branch")
    graph = grids.transition(pp.grid(spark)).select(branch, F.col("cell").alias("src"), F.col("neighbour").alias("dst"), "weight")
    return {
        "expected": c.select(branch, F.col("cell").alias("section"), "mass"),
        "events": e,
        "placed": e.select(branch, "event_id", F.col("cell").alias("section"), F.lit(1.0).alias("p")),
        "graph": graph,
        "geometry": c.select(branch, "cell", F.col("cell").alias("section"), F.lit(1.0).alias("p")),
        "cells": c,
    }


def branched(spark, sf_dir) -> dict[str, DataFrame]:
    """Inputs of a replay over two branches, each of which admits two thirds of the sections; sections of common cells are neighbours."""
    c, e = cut(cells(spark, sf_dir)), cut(events(spark, sf_dir))
    geometry = pp.geometry(spark, sf_dir).where("p > 0").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("branch"), F.col("point").alias("cell"), "section", "p").where("section % 3 <> branch")
    geometry = cut(geometry)
    a = geometry.select("branch", "cell", F.col("section").alias("src"), F.col("p").alias("a"))
    b = geometry.select("branch", "cell", F.col("section").alias("dst"), F.col("p").alias("b"))
    ties = a.join(b, ["branch", "cell"]).where("src <> dst").groupBy("branch", "src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("w"))  # a cell has four sections at most
    total = ties.groupBy("branch", "src").agg(F.sum("w").alias("total"))
    return {
        "expected": geometry.join(c, "cell").groupBy("branch", "section").agg(F.sum(F.col("p") * F.col("mass")).alias("mass")),
        "events": e,
        "placed": e.select("event_id", "cell").join(geometry, "cell").select("branch", "event_id", "section", "p"),
        "graph": ties.join(total, ["branch", "src"]).select("branch", "src", "dst", (F.col("w") / F.col("total")).alias("weight")),
        "geometry": geometry,
        "cells": c,
    }


def ages(inputs: dict[str, DataFrame], members: int = 3) -> DataFrame:
    """Equilibrium ages of an ensemble, another permutation of the quantiles for each member."""
    rows = inputs["expected"].withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(members)])))
    return rows.select("member", "branch", "section", kernels.equilibrium_age((F.col("section") * (2 * F.col("member") + 1) + 7 * F.col("member")) % 16, 16).alias("age"))


# ---------------------------------------------------------------- their SQL

_COMMON = f"""
, cells_ AS (SELECT cell, {SHARE}::DOUBLE * rate AS mass, 6371.0088 * 6371.0088 * radians(1.0) * (sin(radians(cell // 10 + 1.0)) - sin(radians(cell // 10 + 0.0))) / {AREA} AS area FROM bg)
, ev AS (SELECT c.event_id, c.day, c.cell, c.mag, b.rate + 0.1::DOUBLE * d.n AS rate, b.rate / (b.rate + 0.1::DOUBLE * d.n) AS share FROM cat c JOIN dense d USING (cell, day) JOIN bg b USING (cell))
"""
_REGIONAL = pp.CAT.replace("WITH cat0", "WITH RECURSIVE cat0") + pp._BG + _COMMON + """
, expected_ AS (SELECT 0 AS branch, cell AS section, mass FROM cells_), placed_ AS (SELECT 0 AS branch, event_id, cell AS section, 1.0::DOUBLE AS p FROM ev)
, graph_ AS (SELECT 0 AS branch, cell AS src, neighbour AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY cell) AS weight FROM edges), geo_ AS (SELECT 0 AS branch, cell, cell AS section, 1.0::DOUBLE AS p FROM cells_)
"""
_BRANCHED = pp._KNN.replace("WITH cat0", "WITH RECURSIVE cat0") + pp._BG + _COMMON + """
, geo_ AS (SELECT branch, point AS cell, section, p FROM geom CROSS JOIN (VALUES (0), (1)) b(branch) WHERE p > 0 AND section % 3 <> branch)
, expected_ AS (SELECT branch, section, sum(p * mass) AS mass FROM geo_ JOIN cells_ USING (cell) GROUP BY ALL), placed_ AS (SELECT branch, event_id, section, p FROM ev JOIN geo_ USING (cell))
, ties AS (SELECT a.branch, a.section AS src, b.section AS dst, sum(a.p * b.p) AS w FROM geo_ a JOIN geo_ b ON a.branch = b.branch AND a.cell = b.cell AND a.section <> b.section GROUP BY ALL)
, graph_ AS (SELECT branch, src, dst, w / sum(w) OVER (PARTITION BY branch, src) AS weight FROM ties)
"""
_ONE = ", ms AS (SELECT 0 AS member, branch, section, 0.0::DOUBLE AS start FROM expected_)"
_MEMBERS = ", ms AS (SELECT member, branch, section, -ln(1 - ((section * (2 * member + 1) + 7 * member) % 16 + 0.5::DOUBLE) / 16) AS start FROM expected_ CROSS JOIN range(3) m(member))"


def survival_nodes() -> str:
    """Offsets from an age and weights that integrate a density from there on, for ages up to some tens."""
    x, w = np.polynomial.legendre.leggauss(24)
    bounds = [0, 0.25, 0.5, 1, 2, 4, 8, 16, 40]
    return ",".join(f"({(b - a) / 2 * t + (a + b) / 2!r}::DOUBLE,{(b - a) / 2 * v!r}::DOUBLE)" for a, b in zip(bounds, bounds[1:], strict=False) for t, v in zip(x.tolist(), w.tolist(), strict=True))


def _sql(clock: replay.Clock, frailty: replay.Frailty | None, phase: replay.Phase | None, scale: str = "1.0::DOUBLE", ablation: str = "full", branches: int = 1, scoring: int = FIRST) -> str:
    """CTEs from st (states before each day) to rated (events with both rates) and act (days with scores)."""
    hazard, f = kernels.expected_reset_weight(TAIL.beta, TAIL.reference, clock.full, clock.exponent), frailty
    half, prior = (f.half_life, f.prior) if f else (1.0, 1.0)
    r, shape = 0.5 ** (1 / half), 1 / clock.aperiodicity**2
    qf, qs = (0.5 ** (1 / phase.short), 0.5 ** (1 / phase.long)) if phase else (0.5, 0.5)
    frail = f"ln((ro + {prior}::DOUBLE) / (ex + {prior}::DOUBLE))"
    one = "1.0::DOUBLE"
    excess = f"greatest({1 - f.mix!r}::DOUBLE * frail + {f.mix}::DOUBLE * near_frail - {f.floor}::DOUBLE, 0)" if f else "0.0::DOUBLE"
    base = f"{f.overdue_weight}::DOUBLE * overdue + {f.frailty_weight}::DOUBLE * excess" if f else "overdue"
    debt = f"cbrt(overdue * {one if ablation == 'frailty_level_removed' else 'excess'} * {one if ablation == 'acceleration_removed' else 'faster'})" if phase else "0.0::DOUBLE"
    mix = (0.0 if ablation == "network_coherence_removed" else phase.coherence) if phase else 0.0
    weight, floor = (phase.weight, phase.floor) if phase else (0.0, 0.0)
    fraction, sensitivity = (f.fraction, 1.0) if f else (clock.fraction, clock.sensitivity)
    return f"""
, om AS (SELECT branch, section, day, sum(share * p) AS observed, sum({scale} * share * p * least(1.0::DOUBLE, pow(10.0::DOUBLE, {clock.exponent}::DOUBLE * (mag - {clock.full}::DOUBLE)))) AS marked FROM ev JOIN placed_ USING (event_id) GROUP BY ALL)
, st(member, branch, section, day, age, ex, ro, fast, slow) AS (
  SELECT member, branch, section, {FIRST}, start, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM ms UNION ALL
  SELECT s.member, s.branch, s.section, s.day + 1, (s.age + {hazard!r}::DOUBLE * {scale} * e.mass) * exp(-coalesce(o.marked, 0)), {r!r}::DOUBLE * s.ex + e.mass, {r!r}::DOUBLE * s.ro + coalesce(o.observed, 0),
    {qf!r}::DOUBLE * s.fast + {1 - qf!r}::DOUBLE * {frail}, {qs!r}::DOUBLE * s.slow + {1 - qs!r}::DOUBLE * {frail}
  FROM st s JOIN expected_ e ON e.branch = s.branch AND e.section = s.section LEFT JOIN om o ON o.branch = s.branch AND o.section = s.section AND o.day = s.day WHERE s.day < {END})
, td AS (SELECT DISTINCT day FROM ev WHERE day >= {scoring} AND day < {END})
, cur AS (SELECT member, branch, section, day, age, {frail} AS frail, greatest(({qf!r}::DOUBLE * fast + {1 - qf!r}::DOUBLE * {frail}) - ({qs!r}::DOUBLE * slow + {1 - qs!r}::DOUBLE * {frail}) - {floor}::DOUBLE, 0) AS faster FROM st WHERE day IN (SELECT day FROM td))
, nb AS (SELECT c.member, c.branch, g.src AS section, c.day, sum(g.weight * c.age) AS near_age, sum(g.weight * c.frail) AS near_frail FROM graph_ g JOIN cur c ON c.branch = g.branch AND c.section = g.dst GROUP BY ALL)
, ctx AS (SELECT c.*, {1 - clock.mix!r}::DOUBLE * age + {clock.mix}::DOUBLE * coalesce(near_age, age) AS z, coalesce(near_frail, frail) AS near_frail FROM cur c LEFT JOIN nb USING (member, branch, section, day))
, sv(off, w) AS (VALUES {survival_nodes()})
, tail_ AS (SELECT z, sum(w * sqrt({shape / (2 * np.pi)!r}::DOUBLE / (z + off) ** 3) * exp(-{shape}::DOUBLE * (z + off - 1) ** 2 / (2 * (z + off)))) AS s FROM (SELECT DISTINCT z FROM ctx WHERE z > 0) CROSS JOIN sv GROUP BY ALL)
, od AS (SELECT c.*, CASE WHEN z > 0 THEN greatest(0.5::DOUBLE * ln({shape / (2 * np.pi)!r}::DOUBLE / z ** 3) - {shape}::DOUBLE * (z - 1) ** 2 / (2 * z) - ln(s), 0) ELSE 0 END AS overdue, {excess} AS excess FROM ctx c LEFT JOIN tail_ USING (z))
, lo AS (SELECT *, {debt} AS debt FROM od)
, nd AS (SELECT c.member, c.branch, g.src AS section, c.day, sum(g.weight * c.debt) AS near_debt FROM graph_ g JOIN lo c ON c.branch = g.branch AND c.section = g.dst GROUP BY ALL)
, ph AS (SELECT l.*, {1 - mix!r}::DOUBLE * debt + {mix}::DOUBLE * sqrt(debt * coalesce(near_debt, debt)) AS phase FROM lo l LEFT JOIN nd USING (member, branch, section, day))
, sc AS (SELECT member, branch, section, day, {base} + {weight}::DOUBLE * phase AS score, phase FROM ph)
{_scored_sql(clock.consensus, fraction, sensitivity, branches)}
, act AS (SELECT member, day, max(score) > 0 AS active, max(phase) > 0 AS phase_active FROM fl LEFT JOIN (SELECT member, day, max(phase) AS phase FROM sc GROUP BY ALL) USING (member, day) GROUP BY ALL)
"""


def _scored_sql(consensus: float, fraction: float, sensitivity: float, branches: int) -> str:
    """CTEs from bs (branches' scores of cells) to rated (events with both rates)."""
    return f"""
, bs AS (SELECT member, branch, day, cell, sum(p * score) AS s FROM sc JOIN geo_ USING (branch, section) GROUP BY ALL)
, ag AS (SELECT member, day, cell, sum(s) / {branches} * least(greatest((count(*) FILTER (s > 0) / {branches}::DOUBLE - {consensus}::DOUBLE) / {1 - consensus!r}::DOUBLE, 0), 1) AS score FROM bs GROUP BY ALL)
, fl AS (SELECT member, day, cell, mass, area, coalesce(score, 0) AS score FROM cells_ CROSS JOIN td CROSS JOIN (SELECT DISTINCT member FROM ms) LEFT JOIN ag USING (member, day, cell))
, ti AS (SELECT *, mass * exp(least({sensitivity}::DOUBLE * score, 4) - max(least({sensitivity}::DOUBLE * score, 4)) OVER d) AS t, max(abs(score)) OVER d AS top FROM fl WINDOW d AS (PARTITION BY member, day))
, mx AS (SELECT *, CASE WHEN top = 0 THEN mass ELSE ({1 - fraction!r}::DOUBLE * mass / sum(mass) OVER d + {fraction}::DOUBLE * t / sum(t) OVER d) * sum(mass) OVER d END AS mixed FROM ti WINDOW d AS (PARTITION BY member, day))
, ad AS (SELECT day, cell, avg((mixed - mass) / area) AS added FROM mx GROUP BY ALL)
, rated AS (SELECT event_id, rate, rate + added AS challenger, ln(greatest(rate + added, 2.2250738585072014e-308::DOUBLE) / rate) AS gain FROM ev JOIN ad USING (day, cell))"""


_RATED = " SELECT event_id, round(rate, 7) AS rate, round(challenger, 7) AS challenger, round(gain, 7) AS gain FROM rated"


def _rated(found: DataFrame) -> DataFrame:
    return found.select("event_id", *[pp.r(c, 7).alias(c) for c in ("rate", "challenger", "gain")])


# ---------------------------------------------------------------- queries


@query("replay_states", _REGIONAL + _ONE + _sql(CLOCK, FRAILTY, None) + f" SELECT section, day, round(age, 7) AS age, round(ex, 7) AS exposure, round(ro, 7) AS roots FROM st WHERE day IN ({FIRST}, {FIRST + 9}, {END})")
def replay_states(spark, sf_dir):
    """States of all cells at the begin, on a day in between and at the end, which is what a daily step goes on from."""
    i = regional(spark, sf_dir)
    found = replay.states(i["expected"], i["events"], i["placed"], FIRST, END, CLOCK, TAIL, FRAILTY.half_life)
    return found.where(F.col("day").isin(FIRST, FIRST + 9, END)).select("section", "day", *[pp.r(c, 7).alias(c) for c in ("age", "exposure", "roots")])


@query("replay_daily_step", _REGIONAL + _ONE + _sql(CLOCK, FRAILTY, None) + f" SELECT section, round(age, 7) AS age, round(ex, 7) AS exposure, round(ro, 7) AS roots FROM st WHERE day = {END}")
def replay_daily_step(spark, sf_dir):
    """The state before the last day, taken over that day by one daily step."""
    i = regional(spark, sf_dir)
    before = replay.states(i["expected"], i["events"], i["placed"], FIRST, END - 1, CLOCK, TAIL, FRAILTY.half_life).where(F.col("day") == END - 1)
    found = replay.advanced(before, i["expected"], i["events"].where(F.col("day") == END - 1), i["placed"], CLOCK, TAIL, FRAILTY.half_life)
    return found.select("section", *[pp.r(c, 7).alias(c) for c in ("age", "exposure", "roots")])


@query("replay_regional", _REGIONAL + _ONE + _sql(CLOCK, FRAILTY, None) + _RATED)
def replay_regional(spark, sf_dir):
    """Overdue and frail cells raise the background; every event's rate before and after."""
    return _rated(replay.evaluated(**regional(spark, sf_dir), first=FIRST, end=END, clock=CLOCK, tail=TAIL, frailty=FRAILTY)[0])


@query("replay_normalized", _REGIONAL + _ONE + _sql(CLOCK, FRAILTY, None, "(SELECT 1.5::DOUBLE / (avg(mass) * 10) FROM cells_)") + _RATED)
def replay_normalized(spark, sf_dir):
    """The same with a clock whose mean cell expects one and a half events in ten days."""
    i = regional(spark, sf_dir)
    scale = replay.exposure_scale(i["cells"], 10.0, 1.5)
    return _rated(replay.evaluated(**i, first=FIRST, end=END, clock=CLOCK, tail=TAIL, frailty=FRAILTY, scale=scale)[0])


@query("replay_renewal", _BRANCHED + _MEMBERS + _sql(CLOCK, None, None, branches=2, scoring=SCORING) + _RATED)
def replay_renewal(spark, sf_dir):
    """The overdue term alone over two branches, rates averaged over three members that begin at equilibrium ages."""
    i = branched(spark, sf_dir)
    return _rated(replay.evaluated(**i, first=FIRST, end=END, clock=CLOCK, tail=TAIL, scoring_start=SCORING, ages=ages(i), branches=2)[0])


@query("replay_frailty", _BRANCHED + _ONE + _sql(CLOCK, FRAILTY, None, branches=2, scoring=SCORING) + _RATED)
def replay_frailty(spark, sf_dir):
    """Overdue and frail sections over two branches."""
    return _rated(replay.evaluated(**branched(spark, sf_dir), first=FIRST, end=END, clock=CLOCK, tail=TAIL, frailty=FRAILTY, scoring_start=SCORING, branches=2)[0])


@query("replay_phase", _BRANCHED + _ONE + _sql(CLOCK, FRAILTY, PHASE, branches=2, scoring=SCORING) + _RATED)
def replay_phase(spark, sf_dir):
    """The same with the term for sections that are overdue, frail and accelerating together with their neighbours."""
    return _rated(replay.evaluated(**branched(spark, sf_dir), first=FIRST, end=END, clock=CLOCK, tail=TAIL, frailty=FRAILTY, phase=PHASE, scoring_start=SCORING, branches=2)[0])


@query("replay_phase_days", _BRANCHED + _ONE + _sql(CLOCK, FRAILTY, PHASE, branches=2, scoring=SCORING) + " SELECT day, active, phase_active FROM act")
def replay_phase_days(spark, sf_dir):
    """Scored days with any score and with any phase."""
    found = replay.evaluated(**branched(spark, sf_dir), first=FIRST, end=END, clock=CLOCK, tail=TAIL, frailty=FRAILTY, phase=PHASE, scoring_start=SCORING, branches=2)[1]
    return found.select("day", "active", "phase_active")


def _ablation(name: str):
    @query(f"replay_{name}", _BRANCHED + _ONE + _sql(CLOCK, FRAILTY, PHASE, ablation=name, branches=2, scoring=SCORING) + _RATED)
    def ablated(spark, sf_dir):
        return _rated(replay.evaluated(**branched(spark, sf_dir), first=FIRST, end=END, clock=CLOCK, tail=TAIL, frailty=FRAILTY, phase=PHASE, ablation=name, scoring_start=SCORING, branches=2)[0])

    return ablated


for _name in replay.ABLATIONS[1:]:
    _ablation(_name)


_SHAPE = 4.0


@query(
    "bpt_overdue",
    pp.CAT + pp._TRAIL + f""", ages AS (SELECT DISTINCT recency / 5.0::DOUBLE AS z FROM tr), sv(off, w) AS (VALUES {survival_nodes()})
    , tail_ AS (SELECT z, sum(w * sqrt({_SHAPE / (2 * np.pi)!r}::DOUBLE / (z + off) ** 3) * exp(-{_SHAPE}::DOUBLE * (z + off - 1) ** 2 / (2 * (z + off)))) AS s FROM ages CROSS JOIN sv GROUP BY ALL)
    SELECT cell, day, round(greatest(0.5::DOUBLE * ln({_SHAPE / (2 * np.pi)!r}::DOUBLE / z ** 3) - {_SHAPE}::DOUBLE * (z - 1) ** 2 / (2 * z) - ln(s), 0), 6) AS score FROM tr JOIN tail_ ON z = recency / 5.0::DOUBLE""",
)
def bpt_overdue(spark, sf_dir):
    """How overdue every cell is on every day, by the days since its last event in units of five."""
    rows = feats.recency(feats.spine(pp.cat(spark, sf_dir), pp.grid(spark)), 365)
    return rows.select("cell", "day", pp.r(special.overdue_column(F.col("recency") / 5.0, _SHAPE**-0.5), 6).alias("score"))


_NODES = ",".join(f"({x!r}::DOUBLE,{w!r}::DOUBLE)" for x, w in zip(*map(lambda a: a.tolist(), np.polynomial.legendre.leggauss(24)), strict=True))


@query(
    "temporal_integral",
    pp.CAT + f""", nodes(x, w) AS (VALUES {_NODES}), gaps AS (SELECT event_id, (us - lag(us) OVER (PARTITION BY cell ORDER BY us, event_id)) / 86400000000.0::DOUBLE AS gap FROM cat)
    , ends AS (SELECT event_id, ln(0.01::DOUBLE) AS lo, ln(gap + 0.01::DOUBLE) AS hi FROM gaps WHERE gap IS NOT NULL)
    SELECT event_id, round(sum((hi - lo) / 2 * w * exp(-(exp((hi - lo) / 2 * x + (hi + lo) / 2) - 0.01::DOUBLE) / 100 - 0.1::DOUBLE * ((hi - lo) / 2 * x + (hi + lo) / 2))), 7) AS integral FROM ends CROSS JOIN nodes GROUP BY ALL""",
)
def temporal_integral(spark, sf_dir):
    """The kernel's mass between every event and the one before it in its cell."""
    w = Window.partitionBy("cell").orderBy("us", "event_id")
    gap = (F.col("us") - F.lag("us").over(w)) / 86_400_000_000
    rows = pp.cat(spark, sf_dir).select("event_id", gap.alias("gap")).where("gap IS NOT NULL")
    return rows.select("event_id", pp.r(special.temporal_integral_column(F.lit(0.0), F.col("gap"), pp.P), 7).alias("integral"))


RULE = replay.Emergence(half_life=6.0, variance_floor=1.0, threshold=0.2, diffusion=0.35, consensus=0.25, fraction=0.5, sensitivity=0.9)


def _emergence_sql(rule: replay.Emergence, branches: int) -> str:
    d = 0.5 ** (1 / rule.half_life)
    return f"""
, om AS (SELECT branch, section, day, sum(share * p) AS observed FROM ev JOIN placed_ USING (event_id) GROUP BY ALL)
, st(member, branch, section, day, ex, va) AS (
  SELECT 0, branch, section, {FIRST}, 0.0::DOUBLE, 0.0::DOUBLE FROM expected_ UNION ALL
  SELECT s.member, s.branch, s.section, s.day + 1, greatest({d!r}::DOUBLE * s.ex + coalesce(o.observed, 0) - e.mass, 0), {d * d!r}::DOUBLE * s.va + e.mass
  FROM st s JOIN expected_ e ON e.branch = s.branch AND e.section = s.section LEFT JOIN om o ON o.branch = s.branch AND o.section = s.section AND o.day = s.day WHERE s.day < {END - 1})
, ms AS (SELECT 0 AS member), td AS (SELECT DISTINCT day FROM ev WHERE day >= {FIRST} AND day < {END})
, cur AS (SELECT member, branch, section, day, ex / sqrt(va + {rule.variance_floor}::DOUBLE) AS z FROM st WHERE day IN (SELECT day FROM td))
, nb AS (SELECT c.member, c.branch, g.src AS section, c.day, sum(g.weight * c.z) AS near_z FROM graph_ g JOIN cur c ON c.branch = g.branch AND c.section = g.dst GROUP BY ALL)
, sc AS (SELECT member, branch, section, day, sqrt(greatest(z - {rule.threshold}::DOUBLE, 0) * greatest({1 - rule.diffusion!r}::DOUBLE * z + {rule.diffusion}::DOUBLE * coalesce(near_z, z) - {rule.threshold}::DOUBLE, 0)) AS score FROM cur LEFT JOIN nb USING (member, branch, section, day))
{_scored_sql(rule.consensus, rule.fraction, rule.sensitivity, branches)}"""


@query("replay_emergence", _BRANCHED + _emergence_sql(RULE, 2) + _RATED)
def replay_emergence(spark, sf_dir):
    """Rates under a background tilted to sections whose excess their neighbours share, over two branches."""
    return _rated(replay.emerged(**branched(spark, sf_dir), first=FIRST, end=END, rule=RULE, branches=2))


@query(
    "composed_forecast",
    pp.CAT + pp._BG + pp._MARGIN + """, c AS (SELECT cell, rate, rate + 0.01::DOUBLE * n AS total, rate * exp(0.4::DOUBLE * score - max(0.4::DOUBLE * score) OVER ()) AS t FROM mg) SELECT cell, round(total - rate + t * sum(rate) OVER () / sum(t) OVER (), 7) AS composed FROM c""",
)
def composed_forecast(spark, sf_dir):
    """Rates whose background alone follows the margin; the totals are checked."""
    rows = pp._margins(spark, sf_dir).withColumn("total", F.col("rate") + 0.01 * F.col("n"))
    found = forecast.checked_total(forecast.composed(rows, ["all"], "total", "rate", "score", 0.4), ["all"], "total", "composed")
    return found.select("cell", pp.r("composed", 7).alias("composed"))


# ---------------------------------------------------------------- fields

_SMOOTH, _TOLERANCE = 4.0, 1e-6


def count_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Neighbouring cells tied by the root of their counts' product, and every cell's excess over the mean count."""
    n = pp.grid(spark).select("cell").join(pp.cat(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").fillna(0, ["n"])
    e = grids.edges(pp.grid(spark))
    ends = e.join(n.withColumnRenamed("n", "a"), "cell").join(n.select(F.col("cell").alias("neighbour"), F.col("n").alias("b")), "neighbour")
    graph = ends.select(F.col("cell").alias("src"), F.col("neighbour").alias("dst"), F.sqrt(F.col("a") * F.col("b")).alias("weight"))
    mean = n.agg(F.avg("n").alias("mean"))
    return graph, n.join(F.broadcast(mean)).select(F.lit(0).alias("particle"), F.col("cell").alias("node"), (F.col("n") - F.col("mean")).alias("value"))


def _field_sql() -> str:
    """The Chebyshev terms one after the other, each from the two before it."""
    c = fields.coefficients(_SMOOTH, _TOLERANCE)
    step = "SELECT p.node, {f} * -coalesce(sum(h.weight * q.v), 0) - {b} AS v FROM t{k} p LEFT JOIN hat h ON h.src = p.node LEFT JOIN t{k} q ON q.node = h.dst {o} GROUP BY p.node"
    terms = [", t0 AS MATERIALIZED (SELECT cell AS node, n - avg(n) OVER () AS v FROM cnt)"]
    for k in range(1, len(c)):
        older = "" if k == 1 else f"JOIN (SELECT node, v AS old FROM t{k - 2}) o ON o.node = p.node"
        terms.append(f", t{k} AS MATERIALIZED ({step.format(f=1 if k == 1 else 2, b='0' if k == 1 else 'o.old', k=k - 1, o=older)}{'' if k == 1 else ', o.old'})")
    return "".join(terms) + " SELECT node, round(sum(v), 4) + 0.0 AS field FROM (" + " UNION ALL ".join(f"SELECT node, {x!r}::DOUBLE * v AS v FROM t{k}" for k, x in enumerate(c)) + ") GROUP BY ALL"


@query(
    "graph_field",
    pp.CAT + pp._BG + """, tie AS (SELECT e.cell AS src, e.neighbour AS dst, sqrt(a.n * b.n) AS weight FROM edges e JOIN cnt a ON a.cell = e.cell JOIN cnt b ON b.cell = e.neighbour WHERE a.n * b.n > 0)
    , deg AS (SELECT src, sum(weight) AS d FROM tie GROUP BY ALL), hat AS MATERIALIZED (SELECT t.src, t.dst, weight / sqrt(a.d * b.d) AS weight FROM tie t JOIN deg a ON a.src = t.src JOIN deg b ON b.src = t.dst)""" + _field_sql(),
)
def graph_field(spark, sf_dir):
    """The inverse root of the graph's precision applied to the cells' excess counts."""
    graph, values = count_graph(spark, sf_dir)
    return fields.inverse_root(values, graph, _SMOOTH, _TOLERANCE).select("node", pp.r("value", 4).alias("field"))


@query("field_ensemble")
def field_ensemble(spark, sf_dir):
    """Sixteen conditioned draws over the cells; even particles admit the cells without every third column, odd ones all."""
    graph, values = count_graph(spark, sf_dir)
    nodes = values.select("node")
    masks = nodes.withColumn("particle", F.explode(F.sequence(F.lit(0), F.lit(15)))).where("particle % 2 = 1 OR node % 3 <> 0")
    return fields.ensemble(nodes, graph, 16, _SMOOTH, 3, _TOLERANCE, masks)


# ---------------------------------------------------------------- day-ahead work


@query("carried_states", _REGIONAL + _ONE + _sql(CLOCK, FRAILTY, None) + f" SELECT section, round(age, 7) AS age, round(ex, 7) AS exposure, round(ro, 7) AS roots FROM st WHERE day = {END}")
def carried_states(spark, sf_dir):
    """The state after the whole month, from the stored state of its eleventh day and the days after it."""
    i = regional(spark, sf_dir)
    day = FIRST + 11
    stored = replay.states(i["expected"], i["events"].where(F.col("day") < day), i["placed"], FIRST, day, CLOCK, TAIL, FRAILTY.half_life).where(F.col("day") == day)
    stored = prospective.valid_state(cut(stored.select("branch", "section", "age", "exposure", "roots")), i["expected"])
    found = prospective.carried(stored, i["expected"], i["events"].where(F.col("day") >= day), i["placed"], day, END, CLOCK, TAIL, FRAILTY.half_life)
    return found.select("section", *[pp.r(c, 7).alias(c) for c in ("age", "exposure", "roots")])


_NEXT = ", ahead AS (SELECT cell, mass, mixed, area FROM mx WHERE day = (SELECT max(day) FROM td))"


def _ahead(spark, sf_dir, i):
    before = replay.states(i["expected"], i["events"], i["placed"], FIRST, END - 1, CLOCK, TAIL, FRAILTY.half_life).where(F.col("day") == END - 1)
    return cut(prospective.background_forecast(before, i["graph"], i["geometry"], i["cells"], END - 1, CLOCK, FRAILTY, branches=2))


@query("forecast_artefacts", _BRANCHED + _ONE + _sql(CLOCK, FRAILTY, None, branches=2) + _NEXT + f" SELECT cell, round(5 * mass, 8) AS baseline, round(5 * mass + mixed - mass, 8) AS challenger, round(ln((5 * mass + mixed - mass) / (5 * mass)), 7) + 0.0 AS log_ratio FROM ahead WHERE (SELECT max(day) FROM td) = {END - 1}")
def forecast_artefacts(spark, sf_dir):
    """Both grids of the last day, made before it; the base forecast is five times the background."""
    i = branched(spark, sf_dir)
    base = i["cells"].select("cell", (5 * F.col("mass")).alias("rate"))
    found = prospective.artefacts(base, _ahead(spark, sf_dir, i))
    return found.select("cell", pp.r("baseline").alias("baseline"), pp.r("challenger").alias("challenger"), pp.r("log_ratio", 7).alias("log_ratio"))


@query("day_ahead_scores", _BRANCHED + _ONE + _sql(CLOCK, FRAILTY, None, branches=2) + f" SELECT event_id, round(rate, 7) AS rate, round(challenger, 7) AS challenger, round(gain, 7) AS gain FROM rated WHERE event_id IN (SELECT event_id FROM ev WHERE day = {END - 1})")
def day_ahead_scores(spark, sf_dir):
    """The last day's events under the forecast that was made before it; equal to the replay of the whole month."""
    i = branched(spark, sf_dir)
    return _rated(prospective.scored_events(i["events"].where(F.col("day") == END - 1).select("event_id", "cell", "rate"), _ahead(spark, sf_dir, i)))


@query(
    "root_mass",
    _BRANCHED + """, on_ AS (SELECT day, branch, section, sum(share * p) AS mass FROM ev JOIN placed_ USING (event_id) GROUP BY ALL), who AS (SELECT day, sum(share) AS w FROM ev GROUP BY ALL)
    SELECT day, branch, section, round(mass, 7) AS mass FROM on_ UNION ALL SELECT day, branch, NULL::BIGINT, round(w - coalesce(sum(mass), 0), 7) AS mass FROM who CROSS JOIN (SELECT DISTINCT branch FROM placed_) LEFT JOIN on_ USING (day, branch) GROUP BY day, branch, w""",
)
def root_mass(spark, sf_dir):
    """Background mass of every day, branch and section, and what is off the sections."""
    i = branched(spark, sf_dir)
    return prospective.root_mass(i["events"], i["placed"]).select("day", "branch", "section", pp.r("mass", 7).alias("mass"))


@query(
    "particle_backgrounds",
    _BRANCHED + """, sp AS (SELECT particle, section, sin(section * (particle + 1)) AS margin FROM (SELECT DISTINCT section FROM geom WHERE p > 0) CROSS JOIN range(3) t(particle)), pm AS (SELECT particle, point AS cell, sum(p * margin) AS margin FROM geom JOIN sp USING (section) WHERE p > 0 GROUP BY ALL)
    , pt AS (SELECT r.particle, c.cell, c.mass, c.mass * exp(0.8::DOUBLE * coalesce(m.margin, 0)) AS t FROM cells_ c CROSS JOIN range(3) r(particle) LEFT JOIN pm m ON m.particle = r.particle AND m.cell = c.cell)
    , pa AS (SELECT particle, cell, t * sum(mass) OVER (PARTITION BY particle) / sum(t) OVER (PARTITION BY particle) AS adjusted FROM pt) SELECT CAST(particle AS INTEGER) AS particle, event_id, round(adjusted, 8) AS adjusted FROM ev JOIN pa USING (cell)""",
)
def particle_backgrounds(spark, sf_dir):
    """Three particles' backgrounds at every event."""
    near = pp.geometry(spark, sf_dir).where("p > 0")
    particle = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("particle")
    states = near.select("section").distinct().select("section", particle).withColumn("margin", F.sin(F.col("section") * (F.col("particle") + 1)))
    found = prospective.particle_backgrounds(near, states, cells(spark, sf_dir).select("cell", "mass"), events(spark, sf_dir), 0.8)
    return found.select("particle", "event_id", pp.r("adjusted").alias("adjusted"))


@query(
    "likelihood_score",
    pp.CAT + ", " + pp._TERMS + """, tm AS (SELECT 1e-3::DOUBLE + coalesce(point, 0) AS pt, 0.1::DOUBLE + coalesce(temporal, 0) AS te, 0.1::DOUBLE * (us - since) / 86400000000.0::DOUBLE + coalesce(v, 0) AS co FROM tg t LEFT JOIN pr USING (event_id) LEFT JOIN it USING (event_id))
    SELECT count(*) AS targets, round(avg(ln(pt) - co), 5) AS point_ll, round(avg(ln(te) - co), 5) AS temporal_ll, round(avg(ln(pt) - ln(te)), 5) AS spatial_ll FROM tm""",
)
def likelihood_score(spark, sf_dir):
    """Mean log likelihoods of the strong events."""
    c = pp.cat(spark, sf_dir)
    terms = causal.target_terms(c, pp.P, pp.M0, pp.AREA, c.where("mag >= 2.3").select("event_id", "us", "day"), FIRST * 86_400_000_000, pp.TOLERANCE)
    s = prospective.mean_log_likelihoods(terms)
    return s.select("targets", *[pp.r(x, 5).alias(x) for x in ("point_ll", "temporal_ll", "spatial_ll")])


@query(
    "coherent_counts",
    _REGIONAL + """, q AS (SELECT cell, day, n / 10.0::DOUBLE AS z FROM dense), near AS (SELECT g.src AS cell, q.day, sum(weight * z) AS near_z FROM graph_ g JOIN q ON q.cell = g.dst GROUP BY ALL)
    SELECT cell, day, round(sqrt(greatest(z - 0.2::DOUBLE, 0) * greatest(near_z - 0.2::DOUBLE, 0)), 7) AS coherent FROM q JOIN near USING (cell, day)""",
)
def coherent_counts(spark, sf_dir):
    """Daily counts that a cell and its neighbours both have above a threshold."""
    dense = feats.spine(pp.cat(spark, sf_dir), pp.grid(spark))
    rows = dense.select(F.lit(0).cast("long").alias("member"), F.lit(0).alias("branch"), F.col("cell").alias("section"), "day", (F.col("n") / 10.0).alias("z"))
    graph = grids.transition(pp.grid(spark)).select(F.lit(0).alias("branch"), F.col("cell").alias("src"), F.col("neighbour").alias("dst"), "weight")
    return replay.graph_coherent(rows, graph, "z", 0.2).select(F.col("section").alias("cell"), "day", pp.r("coherent", 7).alias("coherent"))
