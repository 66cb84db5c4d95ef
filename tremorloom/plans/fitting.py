"""Queries of model fitting: the feature matrix, value and gradient of the day-wise tilt, a fit, and a search over a design."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorloom.operators import designs, fit, forecast
from tremorloom.operators import features as feats
from tremorloom.plans import point_process as pp
from tremorloom.plans.registry import query
from tremorloom.session import cut

CLIP, L2, BOUND = 3.0, 0.05, 2.0
#: Fixed weights at which value and gradient are compared.
WEIGHTS = [round(0.15 * math.cos(1.7 * i), 3) for i in range(len(feats.FEATURES))]

_NEAR = ", ".join(f"sum(n_{d}) AS near_{d}" for d in (3, 7, 30, 90))


def _excess(n: str, base: str) -> str:
    return f"ln(greatest(({n} + 7 * greatest({base}, floor)) / 37, floor) / greatest({base}, floor))"


def _faster(a: str, b: str, base: str) -> str:
    return f"ln(({a} / 7.0::DOUBLE + greatest({base}, floor)) / ({b} / 30.0::DOUBLE + greatest({base}, floor)))"


_VALUES = [
    *[f"ln(1 + {who}_{d})" for d in (3, 7, 30, 90) for who in ("n", "near")],
    _excess("n_30", "rate"),
    _excess("near_30", "near_rate"),
    _faster("n_7", "n_30", "rate"),
    _faster("near_7", "near_30", "near_rate"),
    "ln(1 + recency)",
    "ln(1 + CASE WHEN degree < 8 THEN least(quiet, 365) ELSE quiet END)",
    "ln(rate)",
]
_MATRIX = pp.CAT + pp._TRAIL + pp._BG + f"""
, nb AS (SELECT e.cell, t.day, {_NEAR}, sum(b.rate) AS near_rate, min(recency) AS quiet, count(*) AS degree FROM edges e JOIN tr t ON t.cell = e.neighbour JOIN bg b ON b.cell = e.neighbour GROUP BY ALL)
, fx AS (SELECT t.cell, t.day, t.n, b.rate, {", ".join(f"{v} AS {f}" for v, f in zip(_VALUES, feats.FEATURES, strict=True))} FROM tr t JOIN bg b USING (cell) JOIN nb USING (cell, day) CROSS JOIN (SELECT avg(rate) * 0.1::DOUBLE AS floor FROM bg))
"""


def matrix(spark, sf_dir) -> DataFrame:
    return feats.matrix(pp.cat(spark, sf_dir), pp.grid(spark), pp.DAYS)


@query("feature_matrix", _MATRIX + "SELECT cell, day, n, " + ", ".join(f"round({f}, 7) + 0.0 AS {f}" for f in feats.FEATURES) + " FROM fx")
def feature_matrix(spark, sf_dir):
    """All fifteen transformed features of every cell-day."""
    return matrix(spark, sf_dir).select("cell", "day", "n", *[pp.r(f, 7).alias(f) for f in feats.FEATURES])


_MOMENTS = "SELECT " + ", ".join(f"avg({f}) AS m{i}, CASE WHEN stddev_pop({f}) < 1e-12 THEN 1 ELSE stddev_pop({f}) END AS s{i}" for i, f in enumerate(feats.FEATURES)) + " FROM fx"
_DESIGN = _MATRIX + f"""
, mo AS ({_MOMENTS}), zx AS (SELECT cell, day, n, rate, {", ".join(f"least(greatest(({f} - m{i}) / s{i}, -3), 3) AS x{i}" for i, f in enumerate(feats.FEATURES))} FROM fx, mo)
, ox AS (SELECT *, {" + ".join(f"{w!r}::DOUBLE * x{i}" for i, w in enumerate(WEIGHTS))} AS o FROM zx), tx AS (SELECT *, rate * exp(o - max(o) OVER (PARTITION BY day)) AS t, max(o) OVER (PARTITION BY day) AS top FROM ox)
, dx AS (SELECT day, sum(n)::DOUBLE AS events, sum(n * o) - sum(n) * (max(top) + ln(sum(t)) - ln(sum(rate))) AS gain, max(top) + ln(sum(t)) - ln(sum(rate)) AS z, {", ".join(f"sum(n * x{i}) - sum(n) * sum(t * x{i}) / sum(t) AS g{i}" for i in range(len(WEIGHTS)))} FROM tx GROUP BY ALL)
"""


def objective(spark, sf_dir) -> fit.Objective:
    rows = cut(matrix(spark, sf_dir))
    scaled = fit.Scaler.of(rows, feats.FEATURES, CLIP).transformed(rows)
    return fit.Objective(cut(scaled), feats.FEATURES, CLIP, L2, target="n")


@query("fit_days", _DESIGN + "SELECT day, events, round(gain, 6) + 0.0 AS gain, " + ", ".join(f"round(g{i}, 6) + 0.0 AS g{i}" for i in range(len(WEIGHTS))) + " FROM dx")
def fit_days(spark, sf_dir):
    """Every day's gain and gradient at fixed weights."""
    days = objective(spark, sf_dir).days(WEIGHTS)
    return days.select("day", "events", pp.r("gain", 6).alias("gain"), *[pp.r(f"g{i}", 6).alias(f"g{i}") for i in range(len(WEIGHTS))])


@query("fit_summary", _DESIGN + "SELECT sum(events)::BIGINT AS events, round(sum(gain), 5) AS gain, round(sum(gain) / sum(events), 8) AS per_event, count(*) FILTER (gain > 0) AS positive_days, count(*) FILTER (gain < 0) AS negative_days FROM dx")
def fit_summary(spark, sf_dir):
    s = fit.summary(objective(spark, sf_dir).days(WEIGHTS))
    return s.select("events", pp.r("gain", 5).alias("gain"), pp.r("per_event").alias("per_event"), "positive_days", "negative_days")


@query("fit_log_ratios", _DESIGN + "SELECT cell, t.day, round(o - z, 7) + 0.0 AS log_ratio FROM tx t JOIN dx USING (day)")
def fit_log_ratios(spark, sf_dir):
    o = objective(spark, sf_dir)
    return fit.log_ratios(o.rows, dict(zip(feats.FEATURES, WEIGHTS, strict=True))).select("cell", "day", pp.r("log_ratio", 7).alias("log_ratio"))


@query("fit_weights")
def fit_weights(spark, sf_dir):
    """The weights that fit the whole catalogue best within their box, with the gradient that is left."""
    o = objective(spark, sf_dir)
    weights = fit.minimized(o, [0.0] * len(feats.FEATURES), -BOUND, BOUND, tolerance=1e-6)
    value, gradient = o(weights)
    return spark.createDataFrame([(f, float(w), float(g), float(value)) for f, w, g in zip(feats.FEATURES, weights, gradient, strict=True)], "feature string, weight double, gradient double, objective double")


BOUNDS, SCALES, POWER, SEED = {"sensitivity": (0.1, 2.0), "fraction": (0.05, 0.95)}, ["log10", "linear"], 4, 11


def _design_values() -> str:
    rows = ["(0, 0.0::DOUBLE, 0.0::DOUBLE)"]
    for i, (u, v) in enumerate(designs.sobol_points(2, POWER, SEED).tolist()):
        (a, b), (c, d) = BOUNDS.values()
        rows.append(f"({i + 1}, {10 ** (math.log10(a) + u * (math.log10(b) - math.log10(a)))!r}::DOUBLE, {c + v * (d - c)!r}::DOUBLE)")
    return ",".join(rows)


@query(
    "design_search",
    pp.CAT + pp._BG + pp._MARGIN + f""", cand(candidate, sensitivity, fraction) AS (VALUES {_design_values()})
    , tilt AS (SELECT candidate, sensitivity, fraction, cell, n, rate, rate * exp(least(sensitivity * score, 4) - max(least(sensitivity * score, 4)) OVER w) AS t FROM mg CROSS JOIN cand WINDOW w AS (PARTITION BY candidate))
    , mixed AS (SELECT *, (1 - fraction) * rate + fraction * t * sum(rate) OVER w / sum(t) OVER w AS m FROM tilt WINDOW w AS (PARTITION BY candidate))
    , score AS (SELECT candidate, sensitivity, fraction, sum(n * ln(m / rate)) AS gain, min(m / rate) AS low FROM mixed GROUP BY ALL)
    SELECT CAST(candidate AS BIGINT) AS candidate, round(sensitivity, 8) AS sensitivity, round(fraction, 8) AS fraction, round(gain, 6) + 0.0 AS gain, candidate = (SELECT coalesce(arg_max(candidate, gain) FILTER (low > 0.2), 0) FROM score) AS best FROM score""",
)
def design_search(spark, sf_dir):
    """Gains of a bounded mixture over a scrambled design; the best one that leaves every cell a fifth of its rate, else the control."""
    c = designs.candidates(spark, BOUNDS, SCALES, POWER, SEED, control=(0.0, 0.0))
    rows = pp._margins(spark, sf_dir).drop("all").join(F.broadcast(c))  # 2 ** POWER candidates and the control
    tilted = forecast.bounded_mixture(rows.withColumn("score", F.col("sensitivity") * F.col("score")), ["candidate"], "rate", "score", 1.0, 1.0)
    mixed = tilted.withColumn("share", ((1 - F.col("fraction")) * F.col("rate") + F.col("fraction") * F.col("mixed")) / F.col("rate"))
    scores = cut(mixed.groupBy("candidate", "sensitivity", "fraction").agg(F.sum(F.col("n") * F.log("share")).alias("gain"), F.min("share").alias("low")))
    best = forecast.best_candidate(scores, [], "candidate", "gain", F.col("low") > 0.2)
    return scores.join(F.broadcast(best)).select("candidate", pp.r("sensitivity").alias("sensitivity"), pp.r("fraction").alias("fraction"), pp.r("gain", 6).alias("gain"), (F.col("candidate") == F.col("best")).alias("best"))
