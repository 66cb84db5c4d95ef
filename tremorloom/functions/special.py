"""Special functions without SciPy: incomplete gamma and its inverse, E1, error function, inverse Gaussian hazard."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorloom.functions.kernels import Parameters

_EULER = 0.5772156649015329

erfc = np.vectorize(math.erfc, otypes=[float])


def lower_gamma(s: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma for s > 0: a power series below s + 1, a continued fraction above."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    small = (x > 0) & (x < s + 1)
    if small.any():
        z = x[small]
        term = np.full_like(z, 1 / s)
        total = term.copy()
        for k in range(1, 500):
            term = term * z / (s + k)
            total += term
            if (np.abs(term) <= 1e-17 * np.abs(total)).all():
                break
        out[small] = total * np.exp(s * np.log(z) - z - math.lgamma(s))
    large = x >= s + 1
    if large.any():
        z = x[large]
        out[large] = 1 - _fraction(s, z) * np.exp(s * np.log(z) - z - math.lgamma(s))
    return out


def _fraction(s: float, z: np.ndarray) -> np.ndarray:
    """Upper gamma times exp(z) z^-s, by Lentz's method."""
    b = z + 1 - s
    c, d = np.full_like(z, 1e300), 1 / b
    h = d.copy()
    for i in range(1, 500):
        a = -i * (i - s)
        b = b + 2
        d = 1 / (a * d + b)
        c = b + a / c
        step = c * d
        h = h * step
        if (np.abs(step - 1) < 1e-16).all():
            break
    return h


def upper_gamma(s: float, x: np.ndarray) -> np.ndarray:
    """Upper incomplete gamma, not regularised, for any real s and x > 0; recurrence lifts s above zero."""
    x = np.asarray(x, float)
    if s > 0:
        return (1 - lower_gamma(s, x)) * math.gamma(s)
    if s == 0:
        return e1(x)
    return (upper_gamma(s + 1, x) - np.exp(s * np.log(x) - x)) / s


def e1(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.empty_like(x)
    small = x < 1
    if small.any():
        z = x[small]
        total, term = np.zeros_like(z), np.ones_like(z)
        for k in range(1, 60):
            term = -term * z / k
            total -= term / k
        out[small] = -_EULER - np.log(z) + total
    if (~small).any():
        z = x[~small]
        out[~small] = _fraction(0.0, z) * np.exp(-z)
    return out


def inverse_lower_gamma(s: float, p: np.ndarray) -> np.ndarray:
    """x with lower_gamma(s, x) = p, by bisection in log x, then Newton steps."""
    p = np.asarray(p, float)
    low, high = np.full_like(p, -700.0), np.full_like(p, 7.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = lower_gamma(s, np.exp(mid)) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.exp((low + high) / 2)


def temporal_integral(lower: np.ndarray, upper: np.ndarray, p: Parameters) -> np.ndarray:
    """Integral of the tapered time kernel between two delays."""
    a, b = (np.asarray(lower, float) + p.c) / p.tau, (np.asarray(upper, float) + p.c) / p.tau
    if p.omega == 0:
        return math.exp(p.c / p.tau) * (e1(a) - e1(b))
    return math.exp(p.c / p.tau) * p.tau**-p.omega * (upper_gamma(-p.omega, a) - upper_gamma(-p.omega, b))


def temporal_integral_column(lower: Column, upper: Column, p: Parameters) -> Column:
    @F.pandas_udf("double")
    def integral(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(temporal_integral(a.to_numpy(), b.to_numpy(), p))

    return integral(lower, upper)


def log_normal_tail(u: np.ndarray) -> np.ndarray:
    """Logarithm of the chance of a standard normal above u, by its asymptotic series where the chance itself would vanish."""
    u = np.asarray(u, float)
    far = np.maximum(u, 20.0)
    v = far**-2
    series = -0.5 * far * far - np.log(far * math.sqrt(2 * math.pi)) + np.log1p(v * (-1 + v * (3 + v * (-15 + v * (105 - 945 * v)))))
    return np.where(u > 20, series, np.log(0.5 * erfc(np.minimum(u, 20.0) / math.sqrt(2))))


def overdue(age: np.ndarray, aperiodicity: float) -> np.ndarray:
    """Positive part of the log hazard of the inverse Gaussian with mean 1, at any age; 0 at age 0."""
    x = np.asarray(age, float)
    shape = 1 / aperiodicity**2
    out = np.zeros_like(x)
    ok = x > 0
    z = x[ok]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        log_density = 0.5 * np.log(shape / (2 * np.pi * z**3)) - shape * (z - 1) ** 2 / (2 * z)
        root = np.sqrt(shape / z)
        first = log_normal_tail(root * (z - 1))
        survival = first + np.log1p(-np.exp(np.minimum(2 * shape + log_normal_tail(root * (z + 1)) - first, -1e-15)))
    out[ok] = np.maximum(log_density - survival, 0.0)
    return out


def overdue_column(age: Column, aperiodicity: float) -> Column:
    @F.pandas_udf("double")
    def score(a: pd.Series) -> pd.Series:
        return pd.Series(overdue(a.to_numpy(), aperiodicity))

    return score(age)


def branching_ratio(beta: float, p: Parameters) -> float:
    """Mean number of direct offspring over an exponential magnitude distribution."""
    if beta <= p.productivity_exponent:
        raise ValueError("the magnitude distribution must fall faster than productivity grows")
    time = float(temporal_integral(np.zeros(1), np.array([1e12]), p)[0])
    space = math.pi / p.rho * p.d**-p.rho
    return p.k0 * time * space * beta / (beta - p.productivity_exponent)
