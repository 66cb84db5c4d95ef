"""Fitting a day-wise softmax tilt of baseline rates: value and gradient as one distributed aggregation, steps on the driver.

A step reads the rows once: each day's sums over its cells are mergeable, so they are combined before they are shuffled, and a
second grouping over days leaves one row of as many numbers as there are features. Only that row and the weights pass the driver.
Rows: (day, rate > 0, target >= 0, features). Null targets count as 0; a rate that is not positive is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets are taken less their bound, so that no day's largest needs to be known; beyond this bound small terms would vanish.
STEEPEST = 600.0


@dataclass(frozen=True)
class Scaler:
    """Means and scales of features, and where standardised values are clipped."""

    means: Mapping[str, float]
    scales: Mapping[str, float]
    clip: float

    @classmethod
    def of(cls, rows: DataFrame, features: Sequence[str], clip: float) -> Scaler:
        """Population moments in one pass; a feature without spread has scale 1."""
        if clip <= 0:
            raise ValueError("the clip must be positive")
        sums = rows.agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
        if not sums["n"]:
            raise ValueError("a scaler needs rows")
        return cls({f: sums[f"m{i}"] for i, f in enumerate(features)}, {f: s if (s := sums[f"s{i}"]) >= 1e-12 else 1.0 for i, f in enumerate(features)}, clip)

    def value(self, feature: str) -> Column:
        z = (F.col(feature) - self.means[feature]) / self.scales[feature]
        return F.least(F.greatest(z, F.lit(-self.clip)), F.lit(self.clip))

    def transformed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: self.value(f) for f in self.means})


@dataclass
class Objective:
    """-gain per target event plus half l2 times the squared weights, with its gradient; repeated weights are not evaluated again."""

    rows: DataFrame
    features: Sequence[str]
    clip: float
    l2: float = 0.0
    day: str = "day"
    rate: str = "rate"
    target: str = "target"
    evaluations: int = 0
    _known: dict[tuple[float, ...], tuple[float, np.ndarray]] = field(default_factory=dict)

    def days(self, weights: Sequence[float]) -> DataFrame:
        """(day, events, gain, g0, g1, ...): each day's gain and gradient."""
        bound = self.clip * float(np.abs(weights).sum())
        if bound > STEEPEST:
            raise ValueError(f"weights of {bound:.0f} in all are too steep for the clip; bound them")
        bad = F.raise_error(F.lit("rates must be positive"))
        rate = F.when(F.col(self.rate) > 0, F.col(self.rate)).otherwise(bad.cast("double"))
        offset = sum((float(w) * F.col(f) for w, f in zip(weights, self.features, strict=True)), F.lit(0.0))
        r = self.rows.select(F.col(self.day).alias("day"), rate.alias("rate"), F.coalesce(F.col(self.target).cast("double"), F.lit(0.0)).alias("t"), offset.alias("o"), *self.features)
        r = r.withColumn("tilted", F.col("rate") * F.exp(F.col("o") - bound))
        sums = r.groupBy("day").agg(
            F.sum("t").alias("events"), F.sum(F.col("t") * F.col("o")).alias("to"), F.sum("tilted").alias("z"), F.sum("rate").alias("r"), *[F.sum(F.col("tilted") * F.col(f)).alias(f"z{i}") for i, f in enumerate(self.features)], *[F.sum(F.col("t") * F.col(f)).alias(f"t{i}") for i, f in enumerate(self.features)]
        )
        gain = F.col("to") - F.col("events") * (bound + F.log("z") - F.log("r"))
        return sums.select("day", "events", gain.alias("gain"), *[(F.col(f"t{i}") - F.col("events") * F.col(f"z{i}") / F.col("z")).alias(f"g{i}") for i in range(len(self.features))])

    def gain(self, weights: Sequence[float]) -> tuple[float, np.ndarray, float]:
        """Log gain over all days, its gradient, and the number of target events."""
        n = len(self.features)
        row = self.days(weights).agg(F.sum("gain"), F.sum("events"), *[F.sum(f"g{i}") for i in range(n)]).first()
        return row[0] or 0.0, np.array([v or 0.0 for v in row[2:]]), row[1] or 0.0

    def __call__(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        key = tuple(float(w) for w in weights)
        if key not in self._known:
            gain, gradient, events = self.gain(key)
            if events <= 0:
                raise ValueError("there are no target events")
            self.evaluations += 1
            w = np.array(key)
            self._known[key] = -gain / events + 0.5 * self.l2 * float(w @ w), -gradient / events + self.l2 * w
        return self._known[key]


def minimized(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: Sequence[float], low: float, high: float, steps: int = 100, memory: int = 8, tolerance: float = 1e-7) -> np.ndarray:
    """The minimum within a box: limited-memory quasi-Newton steps over the free weights, projected and backtracked.

    Weights at a bound that the gradient pushes outwards are held. Ends where no free weight has a gradient above the tolerance;
    raises if that is not reached in so many steps.
    """
    x = np.clip(np.asarray(start, float), low, high)
    value, gradient = objective(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        free = ~(((x <= low) & (gradient > 0)) | ((x >= high) & (gradient < 0)))
        g = np.where(free, gradient, 0.0)
        if np.abs(g).max(initial=0.0) <= tolerance:
            return x
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        direction = np.where(free, -q, 0.0)
        if direction @ g >= 0:
            pairs, direction = [], -g
        length = 1.0 if pairs else min(1.0, 1.0 / np.abs(g).sum())
        while True:
            to = np.clip(x + length * direction, low, high)
            new, slope = objective(to)
            if new <= value + 1e-4 * (g @ (to - x)):
                break
            length /= 2
            if length < 1e-12:
                if np.abs(g).max() <= math.sqrt(tolerance):
                    return x  # no step is seen any more in double precision
                raise ValueError("no step lowers the objective")
        s, y = to - x, slope - gradient
        if s @ y > 1e-12 * math.sqrt(float(s @ s) * float(y @ y)):
            pairs = [*pairs, (s, y)][-memory:]
        x, value, gradient = to, new, slope
    raise ValueError("the objective did not converge")


def log_ratios(rows: DataFrame, weights: Mapping[str, float], day: str = "day", rate: str = "rate") -> DataFrame:
    """rows with log_ratio, the log of a cell's tilted share of its day over its share before."""
    offset = sum((w * F.col(f) for f, w in weights.items()), F.lit(0.0))
    tilted = rows.withColumn("o_", offset)
    tops = tilted.groupBy(day).agg(F.max("o_").alias("top_"), F.sum(rate).alias("r_"))
    sums = tilted.join(tops, day).groupBy(day).agg((F.log(F.sum(F.col(rate) * F.exp(F.col("o_") - F.col("top_")))) + F.first("top_") - F.log(F.first("r_"))).alias("z_"))
    return tilted.join(sums, day).withColumn("log_ratio", F.col("o_") - F.col("z_")).drop("o_", "z_")


def summary(days: DataFrame) -> DataFrame:
    """One row: target events, gain, gain per event, and days with a gain above and below zero."""
    return days.agg(
        F.sum("events").cast("long").alias("events"), F.sum("gain").alias("gain"), (F.sum("gain") / F.sum("events")).alias("per_event"), F.count_if(F.col("gain") > 0).alias("positive_days"), F.count_if(F.col("gain") < 0).alias("negative_days")
    )
