"""Mass-preserving forecasts: tilts, bounded mixtures, consensus, and pair scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.functions import kernels


def softmax_tilt(rows: DataFrame, keys: list[str], background: str, margin: str, sensitivity: float, out: str = "adjusted") -> DataFrame:
    """background redistributed within keys in proportion to exp(sensitivity * margin); totals stay."""
    w = Window.partitionBy(*keys)
    tilted = F.col(background) * F.exp(sensitivity * F.col(margin) - F.max(sensitivity * F.col(margin)).over(w))
    return rows.withColumn("_t", tilted).withColumn(out, F.col("_t") * F.sum(background).over(w) / F.sum("_t").over(w)).drop("_t")


def composed(rows: DataFrame, keys: list[str], total: str, background: str, margin: str, sensitivity: float, out: str = "composed") -> DataFrame:
    """total with its background alone redistributed within keys by the margin; the triggered rest stays where it is."""
    tilted = softmax_tilt(rows, keys, background, margin, sensitivity, "_a")
    return tilted.withColumn(out, kernels.triggered(F.col(total), F.col(background)) + F.col("_a")).drop("_a")


def checked_total(rows: DataFrame, keys: list[str], before: str, after: str, tolerance: float = 1e-9) -> DataFrame:
    """rows, if the sums of two columns agree within keys to a relative tolerance; else the query fails."""
    w = Window.partitionBy(*keys)
    apart = F.abs(F.sum(after).over(w) - F.sum(before).over(w)) > tolerance * F.greatest(F.abs(F.sum(before).over(w)), F.lit(1.0))
    return rows.withColumn("_ok", F.when(apart, F.raise_error(F.lit(f"totals of {before} and {after} differ")).cast("double")).otherwise(F.col(after))).withColumn(after, F.col("_ok")).drop("_ok")


def bounded_mixture(rows: DataFrame, keys: list[str], background: str, score: str, fraction: float, sensitivity: float, cap: float = 4.0, out: str = "mixed") -> DataFrame:
    """A share of the background tilted by the score with a capped log tilt; the background itself where nothing tilts."""
    w = Window.partitionBy(*keys)
    logit = F.least(sensitivity * F.col(score), F.lit(cap))
    rows = rows.withColumn("_t", F.col(background) * F.exp(logit - F.max(logit).over(w)))
    total = F.sum(background).over(w)
    blend = ((1 - fraction) * F.col(background) / total + fraction * F.col("_t") / F.sum("_t").over(w)) * total
    idle = (F.max(F.abs(F.col(score))).over(w) == 0) if fraction and sensitivity else F.lit(True)
    return rows.withColumn(out, F.when(idle, F.col(background)).otherwise(blend)).drop("_t")


def consensus(scores: DataFrame, keys: list[str], score: str, minimum: float) -> DataFrame:
    """Mean over branches times the clipped share of branches with a positive score."""
    share = F.avg((F.col(score) > 0).cast("double"))
    support = F.least(F.greatest((share - minimum) / (1 - minimum), F.lit(0.0)), F.lit(1.0))
    return scores.groupBy(*keys).agg((F.avg(score) * support).alias("consensus"))


def conditional_gain(rows: DataFrame, day: str, rate: str, offset: Column, target: str) -> DataFrame:
    """Per day: sum of target * offset minus the events' share of the log normaliser, by log-sum-exp."""
    r = rows.withColumn("_o", offset)
    top = F.max("_o").over(Window.partitionBy(day))
    agg = r.withColumn("_m", top).groupBy(day).agg(
        F.sum(F.col(target) * F.col("_o")).alias("a"), F.sum(target).alias("n"), (F.log(F.sum(F.col(rate) * F.exp(F.col("_o") - F.col("_m")))) + F.max("_m") - F.log(F.sum(rate))).alias("z")
    )
    return agg.select(day, F.col("n").alias("events"), (F.col("a") - F.col("n") * F.col("z")).alias("gain"))


def rate_of(events: DataFrame, rates: DataFrame, keys: list[str], out: str = "rate") -> DataFrame:
    """events with the rate of their key as out; an event whose key has no rate, or a null one, ends the query with an error."""
    missing = F.raise_error(F.concat(F.lit("no rate for "), F.to_json(F.struct(*keys))))
    found = events.join(rates.select(*keys, F.col("rate").alias("rate_")), keys, "left")
    return found.withColumn(out, F.when(F.col("rate_").isNull(), missing.cast("double")).otherwise(F.col("rate_"))).drop("rate_")


def rate_pairs(events: DataFrame, baseline: DataFrame, challenger: DataFrame, keys: list[str]) -> DataFrame:
    """events with both rates of their cell and the log ratio; an event without a rate in either is an error, see rate_of."""
    both = rate_of(rate_of(events, baseline, keys, "base"), challenger, keys, "other")
    return both.withColumn("gain", kernels.information_gain(F.col("other"), F.col("base")))


def background_shares(events: DataFrame, totals: DataFrame, background: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """events with share, the background part of the total rate of their key, within 0 and 1."""
    both = rate_of(rate_of(events, totals, keys, "total"), background, [cell], "own")
    return both.withColumn("share", F.least(F.greatest(F.col("own") / F.col("total"), F.lit(0.0)), F.lit(1.0))).drop("total", "own")


def best_candidate(scores: DataFrame, keys: list[str], candidate: str, score: str, admitted: Column, control: int = 0) -> DataFrame:
    """(keys, best): the admitted candidate of the highest score, of equal ones the least; the control where none is admitted."""
    rank = F.max(F.when(admitted, F.struct(F.col(score), (-F.col(candidate)).alias("c"))))
    return scores.groupBy(*keys).agg(F.coalesce(-rank["c"], F.lit(control)).alias("best"))


def rate_differences(pairs: DataFrame, actual: str, expected: str) -> DataFrame:
    """(largest, mean) absolute difference of two columns; a pair with a null counts in neither."""
    apart = F.abs(F.col(actual) - F.col(expected))
    return pairs.agg(F.max(apart).alias("largest"), F.avg(apart).alias("mean"))
