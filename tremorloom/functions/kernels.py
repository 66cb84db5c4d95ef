"""Point-process scalars as column expressions: productivity, kernels, reset marks, state and mixture formulas."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest positive normal double; the floor of a rate before its logarithm.
TINY = 2.2250738585072014e-308


@dataclass(frozen=True)
class Parameters:
    """The nine parameters of the triggering model."""

    mu: float
    k0: float
    a: float
    c: float
    omega: float
    tau: float
    d: float
    gamma: float
    rho: float

    def __post_init__(self) -> None:
        for name in ("mu", "k0", "c", "tau", "d", "rho"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")

    @classmethod
    def from_logs(cls, *, log10_mu: float, log10_k0: float, a: float, log10_c: float, omega: float, log10_tau: float, log10_d: float, gamma: float, rho: float) -> Parameters:
        return cls(10**log10_mu, 10**log10_k0, a, 10**log10_c, omega, 10**log10_tau, 10**log10_d, gamma, rho)

    @property
    def productivity_exponent(self) -> float:
        return self.a - self.rho * self.gamma


def rounded_magnitude(m: Column, step: float) -> Column:
    """Half up to a multiple of step."""
    return F.floor(m / step + 0.5) * step


def magnitude_density(m: Column, reference: float, beta: float) -> Column:
    return F.when(m < reference, 0.0).otherwise(beta * F.exp(-beta * (m - reference)))


def productivity(m: Column, reference: float, p: Parameters) -> Column:
    return p.k0 * F.exp(p.a * (m - reference))


def temporal_kernel(t: Column, p: Parameters) -> Column:
    return F.when(t <= 0, 0.0).otherwise(F.exp(-t / p.tau) / F.pow(t + p.c, 1 + p.omega))


def spatial_scale(m: Column, reference: float, p: Parameters) -> Column:
    return p.d * F.exp(p.gamma * (m - reference))


def spatial_kernel(r2: Column, m: Column, reference: float, p: Parameters) -> Column:
    return F.pow(r2 + spatial_scale(m, reference, p), -(1 + p.rho))


def spatial_mass(m: Column, reference: float, p: Parameters, radius: float | None = None) -> Column:
    """Integral of the spatial kernel over a disk, or over the plane."""
    scale = spatial_scale(m, reference, p)
    plane = math.pi / p.rho * F.pow(scale, -p.rho)
    if radius is None:
        return plane
    return plane - math.pi / p.rho * F.pow(scale + radius**2, -p.rho)


def triggering_rate(m: Column, t: Column, r2: Column, reference: float, p: Parameters) -> Column:
    return productivity(m, reference, p) * temporal_kernel(t, p) * spatial_kernel(r2, m, reference, p)


def information_gain(challenger: Column, baseline: Column) -> Column:
    return F.log(F.greatest(challenger, F.lit(TINY)) / baseline)


def triggered(total: Column, background: Column) -> Column:
    """Triggered part of a rate; rounding below zero is clipped."""
    return F.greatest(total - background, F.lit(0.0))


def background_probability(total: Column, background: Column) -> Column:
    return background / (triggered(total, background) + background)


def standardized_excess(excess: Column, variance: Column, floor: float) -> Column:
    return excess / F.sqrt(variance + floor)


def log_frailty(exposure: Column, mass: Column, prior: float) -> Column:
    return F.log((mass + prior) / (exposure + prior))


def positive_frailty(local: Column, neighbour: Column, mix: float, floor: float) -> Column:
    return F.greatest((1 - mix) * local + mix * neighbour - floor, F.lit(0.0))


def reset_weight(m: Column, full: float, exponent: float) -> Column:
    return F.least(F.lit(1.0), F.pow(F.lit(10.0), exponent * (m - full)))


def expected_reset_weight(beta: float, reference: float, full: float, exponent: float) -> float:
    """Mean reset weight under an exponential magnitude tail; the limit where the exponents meet."""
    depth, slope = full - reference, exponent * math.log(10)
    tail = math.exp(-beta * depth)
    if abs(beta - slope) < 1e-9:
        return beta * depth * tail + tail
    return beta / (beta - slope) * math.exp(-slope * depth) * (1 - math.exp(-(beta - slope) * depth)) + tail


def equilibrium_age(i: Column, n: int) -> Column:
    """The i-th of n stratified quantiles of the unit exponential."""
    return -F.log1p(-(i + 0.5) / n)


def log_rate_excess(count: Column, window: float, background: Column, floor: Column) -> Column:
    """Logarithm of a trailing rate, shrunk by seven days of background, over that background."""
    base = F.greatest(background, floor)
    return F.log(F.greatest((count + 7 * base) / (window + 7), floor) / base)


def log_rate_ratio(recent: Column, days: float, longer: Column, long_days: float, base: Column) -> Column:
    return F.log((recent / days + base) / (longer / long_days + base))


def hazard_debt(overdue: Column, frailty: Column, acceleration: Column) -> Column:
    return F.cbrt(overdue * frailty * acceleration)


def direction(mean: Column) -> Column:
    return F.when(mean.isNull(), "unscored").when(mean > 0, "ahead").when(mean < 0, "behind").otherwise("level")


def admissible(mean: Column, robust: Column, worst_year: Column, low_stratum: Column, floor: float) -> Column:
    return (mean > 0) & (robust > 0) & (worst_year >= floor) & (low_stratum >= 0)
