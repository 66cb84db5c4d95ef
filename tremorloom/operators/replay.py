"""Day-by-day replays of a renewal forecast: states of sections before each day, scores over their graph, adjusted rates at events.

A section's clock, exposure and root mass, and the trend of its frailty, follow recurrences of their own, so they are scans along
sorted rows. Sections meet only when a day is scored: over the graph by an equi-join, over branches and the whole grid by
grouping. Only days with target events are scored. A member, branch or section may be any number; a regional replay is one
branch whose sections are the cells. Forecasts see what was before their day alone.

Tables: expected (branch, section, mass) of a day; events (event_id, day, cell, magnitude, rate, share), share being the
background's part of the rate; placed (branch, event_id, section, p); graph (branch, src, dst, weight), rows summing to 1, where a
section without rows is its own neighbour; geometry (branch, cell, section, p); cells (cell, mass, area).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorloom.functions import kernels, special
from tremorloom.operators import forecast
from tremorloom.operators.scan import Step, scanned
from tremorloom.session import cut

KEYS = ["member", "branch", "section"]
#: What an ablation of the phase term leaves out.
ABLATIONS = ("full", "acceleration_removed", "frailty_level_removed", "network_coherence_removed")


@dataclass(frozen=True)
class Clock:
    """The renewal clock: magnitudes that reset it, neighbours' share in its age, the regularity of its law, its tilt."""

    full: float
    exponent: float
    mix: float
    aperiodicity: float
    consensus: float = 0.0
    fraction: float = 0.0
    sensitivity: float = 1.0


@dataclass(frozen=True)
class Frailty:
    """Weights of overdue sections and of frail ones; prior and memory of the Gamma-Poisson state; the share that is tilted."""

    overdue_weight: float
    frailty_weight: float
    prior: float
    half_life: float
    mix: float
    floor: float
    fraction: float


@dataclass(frozen=True)
class Phase:
    """Half-lives and floor of the frailty's acceleration, the neighbours' share in coherence, and the weight of the term."""

    short: float
    long: float
    floor: float
    coherence: float
    weight: float


@dataclass(frozen=True)
class Tail:
    """Exponential magnitudes above a reference."""

    beta: float
    reference: float


def exposure_scale(cells: DataFrame, days: float, target: float = 1.0) -> float:
    """The clock's scale that gives the mean cell `target` expected events in so many days. Non-positive masses are an error."""
    low, mean = cells.agg(F.min("mass"), F.avg("mass")).first()
    if low is None or low <= 0 or days <= 0 or target <= 0:
        raise ValueError("masses, days and target must be positive")
    return target / (mean * days)


def _observed(events: DataFrame, placed: DataFrame, clock: Clock, scale: float) -> DataFrame:
    mark = kernels.reset_weight(F.col("magnitude"), clock.full, clock.exponent)
    met = events.select("event_id", "day", "share", mark.alias("mark")).join(placed, "event_id")
    mass = F.col("share") * F.col("p")
    return met.groupBy("branch", "section", "day").agg(F.sum(mass).alias("observed"), F.sum(scale * mass * F.col("mark")).alias("marked"))


def states(expected: DataFrame, events: DataFrame, placed: DataFrame, first: int, end: int, clock: Clock, tail: Tail, half_life: float, scale: float = 1.0, ages: DataFrame | None = None) -> DataFrame:
    """(member, branch, section, day, age, exposure, roots) before each day from first to end; the row at end is what a replay leaves.

    ages: (member, branch, section, age) that members begin with, and with exposure and roots too if they go on from a stored
    state; without it one member 0 begins at 0. Sections that it lacks begin at 0.
    """
    hazard = scale * kernels.expected_reset_weight(tail.beta, tail.reference, clock.full, clock.exponent)
    zero = F.lit(0.0)
    if ages is None:
        begun = expected.withColumns({"member": F.lit(0).cast("long"), "start": zero, "start_e": zero, "start_r": zero})
    else:
        stored = ages.withColumn("member", F.col("member").cast("long"))
        members = stored.select("member").distinct()
        own = stored.select(*KEYS, *[(F.col(c) if c in ages.columns else zero).alias(f"_{c}") for c in ("age", "exposure", "roots")])
        begun = expected.join(F.broadcast(members)).join(own, KEYS, "left")  # a row a member
        begun = begun.withColumns({"start": F.coalesce("_age", zero), "start_e": F.coalesce("_exposure", zero), "start_r": F.coalesce("_roots", zero)})
    spine = begun.withColumn("day", F.explode(F.sequence(F.lit(first), F.lit(end))))
    rows = spine.join(_observed(events, placed, clock, scale), ["branch", "section", "day"], "left")
    kept, r = F.exp(-F.coalesce("marked", F.lit(0.0))), F.lit(0.5 ** (1 / half_life))
    steps = {
        "age": Step(kept, hazard * F.col("mass") * kept, F.col("start")),
        "exposure": Step(r, F.col("mass"), F.col("start_e")),
        "roots": Step(r, F.coalesce("observed", F.lit(0.0)), F.col("start_r")),
    }
    return scanned(rows.select(*KEYS, "day", "mass", "start", "start_e", "start_r", "observed", "marked"), KEYS, "day", steps).select(*KEYS, "day", "age", "exposure", "roots")


def advanced(state: DataFrame, expected: DataFrame, events: DataFrame, placed: DataFrame, clock: Clock, tail: Tail, half_life: float, scale: float = 1.0) -> DataFrame:
    """The state (branch, section, age, exposure, roots) after one more day with these events; equal to the replay's next row."""
    hazard = scale * kernels.expected_reset_weight(tail.beta, tail.reference, clock.full, clock.exponent)
    seen = _observed(events, placed, clock, scale).groupBy("branch", "section").agg(F.sum("observed").alias("observed"), F.sum("marked").alias("marked"))
    rows = state.join(expected, ["branch", "section"]).join(seen, ["branch", "section"], "left")
    r = 0.5 ** (1 / half_life)
    age = (F.col("age") + hazard * F.col("mass")) * F.exp(-F.coalesce("marked", F.lit(0.0)))
    return rows.select("branch", "section", age.alias("age"), (r * F.col("exposure") + F.col("mass")).alias("exposure"), (r * F.col("roots") + F.coalesce("observed", F.lit(0.0))).alias("roots"))


def _with_neighbours(rows: DataFrame, graph: DataFrame, values: list[str]) -> DataFrame:
    """rows with near_v, the weighted mean of each value over the section's neighbours; its own value where it has none."""
    met = graph.join(rows.select(*[F.col(k).alias("dst") if k == "section" else k for k in KEYS], "day", *values), ["branch", "dst"])
    near = met.groupBy("member", "branch", F.col("src").alias("section"), "day").agg(*[F.sum(F.col("weight") * F.col(v)).alias(f"near_{v}") for v in values])
    return rows.join(near, [*KEYS, "day"], "left").withColumns({f"near_{v}": F.coalesce(f"near_{v}", v) for v in values})


def _mixed(own: str, mix: float) -> Column:
    return (1 - mix) * F.col(own) + mix * F.col(f"near_{own}")


def graph_coherent(rows: DataFrame, graph: DataFrame, score: str, threshold: float) -> DataFrame:
    """rows (member, branch, section, day, score) with coherent: the geometric mean of what the score and its neighbours' are above a threshold."""
    above = lambda c: F.greatest(F.col(c) - threshold, F.lit(0.0))
    return _with_neighbours(rows, graph, [score]).withColumn("coherent", F.sqrt(above(score) * above(f"near_{score}"))).drop(f"near_{score}")


def section_scores(state: DataFrame, graph: DataFrame, days: DataFrame, clock: Clock, frailty: Frailty | None = None, phase: Phase | None = None, ablation: str = "full") -> DataFrame:
    """(member, branch, section, day, score, phase) of the days to score.

    The trend of the frailty takes each day's frailty in before that day is scored. Without frailty the score is the overdue
    term alone.
    """
    if ablation not in ABLATIONS:
        raise ValueError(f"unknown ablation {ablation}")
    rows = state
    if frailty is not None:
        rows = rows.withColumn("frail", kernels.log_frailty(F.col("exposure"), F.col("roots"), frailty.prior))
    if phase is not None:
        keep = {n: 0.5 ** (1 / h) for n, h in (("fast", phase.short), ("slow", phase.long))}
        before = scanned(rows.select(*KEYS, "day", "age", "frail"), KEYS, "day", {n: Step(F.lit(k), (1 - k) * F.col("frail"), F.lit(0.0)) for n, k in keep.items()})
        now = {n: k * F.col(n) + (1 - k) * F.col("frail") for n, k in keep.items()}
        rows = before.withColumn("faster", F.greatest(now["fast"] - now["slow"] - phase.floor, F.lit(0.0))).drop("fast", "slow")
    scored = rows.join(days.select("day").distinct(), "day", "left_semi")
    scored = _with_neighbours(scored, graph, ["age"] + (["frail"] if frailty else []))
    scored = scored.withColumn("overdue", special.overdue_column(_mixed("age", clock.mix), clock.aperiodicity))
    if frailty is None:
        return scored.select(*KEYS, "day", F.col("overdue").alias("score"), F.lit(0.0).alias("phase"))
    scored = scored.withColumn("excess", kernels.positive_frailty(F.col("frail"), F.col("near_frail"), frailty.mix, frailty.floor))
    base = frailty.overdue_weight * F.col("overdue") + frailty.frailty_weight * F.col("excess")
    if phase is None:
        return scored.select(*KEYS, "day", base.alias("score"), F.lit(0.0).alias("phase"))
    one = F.lit(1.0)
    debt = kernels.hazard_debt(F.col("overdue"), one if ablation == "frailty_level_removed" else F.col("excess"), one if ablation == "acceleration_removed" else F.col("faster"))
    local = cut(scored.select(*KEYS, "day", base.alias("base"), debt.alias("debt")))
    mix = 0.0 if ablation == "network_coherence_removed" else phase.coherence
    coherent = (1 - mix) * F.col("debt") + mix * F.sqrt(F.col("debt") * F.col("near_debt"))
    found = _with_neighbours(local, graph, ["debt"]).withColumn("phase", coherent)
    return found.select(*KEYS, "day", (F.col("base") + phase.weight * F.col("phase")).alias("score"), "phase")


def adjusted_cells(scores: DataFrame, geometry: DataFrame, cells: DataFrame, days: DataFrame, branches: int, consensus: float, fraction: float, sensitivity: float, cap: float = 4.0) -> DataFrame:
    """(member, day, cell, mass, area, score, mixed) over all cells of the days to score: branches' scores by consensus, a bounded tilt.

    A cell that a branch's geometry lacks scores 0 there. Masses of a day keep their sum.
    """
    met = scores.join(geometry, ["branch", "section"]).groupBy("member", "branch", "day", "cell").agg(F.sum(F.col("p") * F.col("score")).alias("s"))
    share = F.count_if(F.col("s") > 0) / branches
    support = F.least(F.greatest((share - consensus) / (1 - consensus), F.lit(0.0)), F.lit(1.0))
    agreed = met.groupBy("member", "day", "cell").agg((F.sum("s") / branches * support).alias("score"))
    spine = cells.join(F.broadcast(scores.select("member").distinct())).join(F.broadcast(days.select("day").distinct()))  # members and scored days of the whole grid
    rows = spine.join(agreed, ["member", "day", "cell"], "left").fillna(0.0, ["score"])
    return forecast.bounded_mixture(rows, ["member", "day"], "mass", "score", fraction, sensitivity, cap)


@dataclass(frozen=True)
class Emergence:
    """Memory of the compensated sums, their variance floor and threshold, the neighbours' share, agreement and tilt."""

    half_life: float
    variance_floor: float
    threshold: float
    diffusion: float
    consensus: float
    fraction: float
    sensitivity: float


def emergence_scores(expected: DataFrame, events: DataFrame, placed: DataFrame, graph: DataFrame, first: int, end: int, rule: Emergence) -> DataFrame:
    """(member, branch, section, day, score) before each day: excess over the expected mass that a section and its graph both show.

    The excess is a one-sided sum of observed less expected mass over the root of its variance; the score the geometric mean of
    what it and its mix with the neighbours' are above the threshold.
    """
    met = events.select("event_id", "day", "share").join(placed, "event_id")
    seen = met.groupBy("branch", "section", "day").agg(F.sum(F.col("share") * F.col("p")).alias("observed"))
    spine = expected.withColumn("member", F.lit(0).cast("long")).withColumn("day", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))
    rows = spine.join(seen, ["branch", "section", "day"], "left").select(*KEYS, "day", "mass", F.coalesce("observed", F.lit(0.0)).alias("observed"))
    decay = 0.5 ** (1 / rule.half_life)
    steps = {"excess": Step(F.lit(decay), F.col("observed") - F.col("mass"), F.lit(0.0), 0.0), "variance": Step(F.lit(decay * decay), F.col("mass"), F.lit(0.0))}
    standard = scanned(rows, KEYS, "day", steps).select(*KEYS, "day", kernels.standardized_excess(F.col("excess"), F.col("variance"), rule.variance_floor).alias("z"))
    standard = standard.join(events.select("day").distinct(), "day", "left_semi")
    above = lambda v: F.greatest(v - rule.threshold, F.lit(0.0))
    return _with_neighbours(standard, graph, ["z"]).select(*KEYS, "day", F.sqrt(above(F.col("z")) * above(_mixed("z", rule.diffusion))).alias("score"))


def emerged(expected: DataFrame, events: DataFrame, placed: DataFrame, graph: DataFrame, geometry: DataFrame, cells: DataFrame, first: int, end: int, rule: Emergence, branches: int = 1, cap: float = 4.0) -> DataFrame:
    """Events (event_id, day, cell, rate, challenger, gain) under a background tilted to where excess emerges."""
    targets = events.where((F.col("day") >= first) & (F.col("day") < end))
    scores = cut(emergence_scores(expected, targets, placed, graph, first, end, rule))
    adjusted = adjusted_cells(scores, geometry, cells, targets, branches, rule.consensus, rule.fraction, rule.sensitivity, cap)
    added = adjusted.select("day", "cell", ((F.col("mixed") - F.col("mass")) / F.col("area")).alias("rate"))
    met = forecast.rate_of(targets.withColumnRenamed("rate", "base"), added, ["day", "cell"], "added")
    rated = met.select("event_id", "day", "cell", F.col("base").alias("rate"), (F.col("base") + F.col("added")).alias("challenger"))
    return rated.withColumn("gain", kernels.information_gain(F.col("challenger"), F.col("rate")))


def evaluated(
    expected: DataFrame,
    events: DataFrame,
    placed: DataFrame,
    graph: DataFrame,
    geometry: DataFrame,
    cells: DataFrame,
    first: int,
    end: int,
    clock: Clock,
    tail: Tail,
    frailty: Frailty | None = None,
    phase: Phase | None = None,
    ablation: str = "full",
    scoring_start: int | None = None,
    scale: float = 1.0,
    ages: DataFrame | None = None,
    branches: int = 1,
    cap: float = 4.0,
) -> tuple[DataFrame, DataFrame]:
    """Events (event_id, day, cell, rate, challenger, gain) from the scoring start on, and (member, day, active, phase_active).

    The challenger's rate is the baseline plus what the adjusted background of the event's cell adds a unit of area. Rates are
    averaged over members before the logarithm is taken. An event whose cell is unknown is an error.
    """
    targets = events.where((F.col("day") >= (first if scoring_start is None else scoring_start)) & (F.col("day") < end))
    days = targets.select("day").distinct()
    state = states(expected, events.where((F.col("day") >= first) & (F.col("day") < end)), placed, first, end, clock, tail, frailty.half_life if frailty else 1.0, scale, ages)
    scores = cut(section_scores(state, graph, days, clock, frailty, phase, ablation))
    fraction, sensitivity = (frailty.fraction, 1.0) if frailty else (clock.fraction, clock.sensitivity)
    adjusted = cut(adjusted_cells(scores, geometry, cells, days, branches, clock.consensus, fraction, sensitivity, cap))
    added = adjusted.groupBy("day", "cell").agg(F.avg((F.col("mixed") - F.col("mass")) / F.col("area")).alias("rate"))
    met = forecast.rate_of(targets.withColumnRenamed("rate", "base"), added, ["day", "cell"], "added")
    rated = met.select("event_id", "day", "cell", F.col("base").alias("rate"), (F.col("base") + F.col("added")).alias("challenger"))
    active = adjusted.groupBy("member", "day").agg((F.max("score") > 0).alias("active"))
    phases = scores.groupBy("member", "day").agg((F.max("phase") > 0).alias("phase_active"))
    return rated.withColumn("gain", kernels.information_gain(F.col("challenger"), F.col("rate"))), active.join(phases, ["member", "day"])
