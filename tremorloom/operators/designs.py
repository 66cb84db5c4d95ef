"""Low-discrepancy candidate designs: scrambled Sobol points as bit expressions over a range, scaled to bounds."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 30

#: Degree, inner coefficients and first direction integers of the primitive polynomials of axes 2 to 16, from the
#: published table of Joe and Kuo (2008).
POLYNOMIALS = [
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 1, 3, 3)),
    (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)),
    (5, 11, (1, 1, 5, 1, 1)),
    (5, 13, (1, 1, 1, 3, 11)),
    (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)),
    (6, 13, (1, 1, 1, 15, 21, 21)),
    (6, 16, (1, 3, 1, 13, 27, 49)),
]


def directions(axis: int) -> list[int]:
    """The direction numbers of an axis from 0, BITS of them, the first with the highest bit."""
    if axis == 0:
        return [1 << (BITS - 1 - i) for i in range(BITS)]
    if axis > len(POLYNOMIALS):
        raise ValueError(f"designs have at most {len(POLYNOMIALS) + 1} axes")
    degree, inner, first = POLYNOMIALS[axis - 1]
    v = [m << (BITS - 1 - i) for i, m in enumerate(first)]
    for i in range(degree, BITS):
        x = v[i - degree] ^ (v[i - degree] >> degree)
        for k in range(1, degree):
            if inner >> (degree - 1 - k) & 1:
                x ^= v[i - k]
        v.append(x)
    return v


def scrambled(axes: int, seed: int | None) -> list[tuple[list[int], int]]:
    """Direction numbers and shift of each axis: a random lower-triangular matrix over bits, then a random digital shift."""
    rng = np.random.default_rng(seed)
    out = []
    for axis in range(axes):
        v = directions(axis)
        if seed is None:
            out.append((v, 0))
            continue
        # row r of the matrix mixes the bits above r into bit r, so intervals of halves stay intervals of halves
        rows = [(1 << (BITS - 1 - r)) | (int(rng.integers(0, 1 << r)) << (BITS - r) if r else 0) for r in range(BITS)]
        mixed = [sum(((row & x).bit_count() & 1) << (BITS - 1 - r) for r, row in enumerate(rows)) for x in v]
        out.append((mixed, int(rng.integers(0, 1 << BITS))))
    return out


def sobol_points(axes: int, power: int, seed: int | None = None) -> np.ndarray:
    """The same points on the driver, for a handful of candidates."""
    n = np.arange(1 << power)
    gray, columns = n ^ (n >> 1), []
    for v, shift in scrambled(axes, seed):
        x = np.full(len(n), shift)
        for i in range(power):
            x ^= np.where(gray >> i & 1, v[i], 0)
        columns.append(x * 2.0**-BITS)
    return np.column_stack(columns)


def sobol(spark: SparkSession, axes: int, power: int, seed: int | None = None) -> DataFrame:
    """(id, u0, u1, ...): the first 2 ** power points of a Sobol sequence in [0, 1), scrambled by the seed if there is one."""
    if not 0 <= power <= BITS:
        raise ValueError(f"the power is from 0 to {BITS}")
    gray = F.col("id").bitwiseXOR(F.shiftright("id", 1))
    columns = []
    for axis, (v, shift) in enumerate(scrambled(axes, seed)):
        x = F.lit(shift).cast("long")
        for i in range(power):
            x = x.bitwiseXOR(F.when(F.col("gray").bitwiseAND(1 << i) != 0, F.lit(v[i])).otherwise(F.lit(0)).cast("long"))
        columns.append((x * 2.0**-BITS).alias(f"u{axis}"))
    return spark.range(1 << power).withColumn("gray", gray).select("id", *columns)


def _scaled(u: Column, low: float, high: float, scale: str) -> Column:
    if scale == "linear":
        return low + u * (high - low)
    if scale == "log":
        return F.exp(math.log(low) + u * (math.log(high) - math.log(low)))
    if scale == "log10":
        return F.pow(F.lit(10.0), math.log10(low) + u * (math.log10(high) - math.log10(low)))
    raise ValueError(f"unknown scale {scale}")


def candidates(spark: SparkSession, bounds: dict[str, tuple[float, float]], scales: Sequence[str] | None = None, power: int = 6, seed: int | None = 1, control: Sequence[float] | None = None) -> DataFrame:
    """(candidate, a column for each bound): scaled Sobol points from 1 on, and the control as candidate 0 if there is one."""
    scales = scales or ["linear"] * len(bounds)
    for (name, (low, high)), scale in zip(bounds.items(), scales, strict=True):
        if not low < high or (scale != "linear" and low <= 0):
            raise ValueError(f"bounds of {name} do not suit its scale")
    points = sobol(spark, len(bounds), power, seed)
    values = [_scaled(F.col(f"u{i}"), low, high, scale).alias(name) for i, ((name, (low, high)), scale) in enumerate(zip(bounds.items(), scales, strict=True))]
    design = points.select((F.col("id") + 1).alias("candidate"), *values)
    if control is None:
        return design
    fixed = spark.range(1).select(F.lit(0).cast("long").alias("candidate"), *[F.lit(float(v)).alias(name) for name, v in zip(bounds, control, strict=True)])
    return fixed.unionByName(design)
