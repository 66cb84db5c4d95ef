"""Gaussian fields on a weighted graph: draws with precision I + s L, L the normalised Laplacian, by sparse products alone.

The inverse root of the precision is a Chebyshev polynomial of it, whose terms need one join of the values with the edges each.
Their number follows from a tolerance: the coefficients left out add up to less, which bounds the error of the operator in norm.
Normal numbers depend on seed, component, particle and node alone, so draws are the same however rows are dealt.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorloom.session import cut


def normalised(graph: DataFrame) -> DataFrame:
    """(src, dst, weight) of a symmetric graph with weights over the roots of both ends' degrees. Negative weights are an error."""
    bad = F.raise_error(F.lit("weights must not be negative")).cast("double")
    g = graph.select("src", "dst", F.when(F.col("weight") >= 0, F.col("weight")).otherwise(bad).alias("weight")).where("weight > 0")
    degree = g.groupBy("src").agg(F.sum("weight").alias("degree"))
    ends = g.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("other")), "dst")
    return ends.select("src", "dst", (F.col("weight") / F.sqrt(F.col("degree") * F.col("other"))).alias("weight"))


def coefficients(smoothness: float, tolerance: float, most: int = 2000) -> list[float]:
    """Chebyshev coefficients of 1 / sqrt(1 + s + s y) on [-1, 1], as many as leave out less than the tolerance in sum."""
    if smoothness < 0 or tolerance <= 0:
        raise ValueError("smoothness must not be negative, the tolerance positive")
    n = 64
    while True:
        at = np.cos(np.pi * (np.arange(n) + 0.5) / n)
        f = 1 / np.sqrt(1 + smoothness + smoothness * at)
        c = np.array([2 / n * (f * np.cos(k * np.arccos(at))).sum() for k in range(n)])
        c[0] /= 2
        left = np.cumsum(np.abs(c[::-1]))[::-1]  # sum from each term on
        if left[n // 2] < tolerance / 2 or n >= most:  # the last half vanishes, so folding back does too
            return c[: max(1, int(np.searchsorted(-left, -tolerance)))].tolist()
        n *= 2


def inverse_root(values: DataFrame, graph: DataFrame, smoothness: float, tolerance: float = 1e-8, keys: tuple[str, ...] = ("particle",)) -> DataFrame:
    """(keys, node, value): (I + s L)^(-1/2) applied to the values of each key, within tolerance times their norm.

    values: (keys, node, value) of every node; graph: (src, dst, weight) as it is given, symmetric. A node without edges is
    divided by sqrt(1 + s). Each term is one equi-join and one grouping, and is written before the next uses it twice.
    """
    c = coefficients(smoothness, tolerance)
    edges = cut(normalised(graph))
    names = [*keys, "node"]
    # the operator whose spectrum is in [-1, 1] is minus the normalised adjacency
    state = cut(values.select(*names, F.lit(0.0).alias("before"), F.col("value").cast("double").alias("now"), (c[0] * F.col("value")).alias("sum")))
    for k in range(1, len(c)):
        met = edges.join(state.select(*[F.col(x).alias("dst") if x == "node" else x for x in names], "now"), "dst")
        product = met.groupBy(*keys, F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("now")).alias("product"))
        after = (1 if k == 1 else 2) * -F.coalesce("product", F.lit(0.0)) - (F.lit(0.0) if k == 1 else F.col("before"))
        state = state.join(product, names, "left").select(*names, F.col("now").alias("before"), after.alias("after"), "sum")
        state = cut(state.select(*names, "before", F.col("after").alias("now"), (F.col("sum") + c[k] * F.col("after")).alias("sum")))
    return state.select(*names, F.col("sum").alias("value"))


def normal(seed: int, *parts: Column) -> Column:
    """Standard normal numbers that depend on the seed and the parts alone."""
    uniform = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), *parts), 11).cast("double") + 0.5) * 2.0**-53
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def conditioned(ensemble: DataFrame, masks: DataFrame) -> DataFrame:
    """ensemble (particle, node, stress, strength) on the nodes that masks (particle, node) admit for each particle.

    Both components are centred over the admitted nodes and scaled by the deviation of their difference, margin; other nodes are
    0. A particle with fewer than two admitted nodes, or without dispersion, is an error.
    """
    flagged = ensemble.join(masks.select("particle", "node", F.lit(1).alias("in_")).distinct(), ["particle", "node"], "left")
    sums = flagged.groupBy("particle").agg(F.count("in_").alias("n"), *[F.avg(F.when(F.col("in_") == 1, F.col(c))).alias(f"mean_{c}") for c in ("stress", "strength")], F.stddev_pop(F.when(F.col("in_") == 1, F.col("stress") - F.col("strength"))).alias("scale"))
    few, flat = (F.raise_error(F.concat(F.lit(text), F.col("particle").cast("string"))).cast("double") for text in ("fewer than two nodes for particle ", "no dispersion in particle "))
    scale = F.when(F.col("n") < 2, few).when(F.col("scale") > 0, F.col("scale")).otherwise(flat)
    value = lambda c: F.when(F.col("in_") == 1, (F.col(c) - F.col(f"mean_{c}")) / F.col("scale")).otherwise(0.0)
    scaled = flagged.join(sums.withColumn("scale", scale), "particle")
    return scaled.select("particle", "node", value("stress").alias("stress"), value("strength").alias("strength")).withColumn("margin", F.col("stress") - F.col("strength"))


def ensemble(nodes: DataFrame, graph: DataFrame, particles: int, smoothness: float = 4.0, seed: int = 1, tolerance: float = 1e-8, masks: DataFrame | None = None) -> DataFrame:
    """(particle, node, stress, strength, margin): draws of two fields over nodes (node), conditioned on masks or on all nodes."""
    if particles < 2:
        raise ValueError("an ensemble has two particles or more")
    rows = nodes.select("node").distinct().withColumn("particle", F.explode(F.sequence(F.lit(0), F.lit(particles - 1))))
    drawn = rows.withColumn("component", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("value", normal(seed, F.col("component"), F.col("particle"), F.col("node").cast("long")))
    fields = inverse_root(drawn, graph, smoothness, tolerance, ("component", "particle"))
    both = fields.groupBy("particle", "node").agg(*[F.sum(F.when(F.col("component") == i, F.col("value"))).alias(c) for i, c in enumerate(("stress", "strength"))])
    return conditioned(both, rows.select("particle", "node") if masks is None else masks)
