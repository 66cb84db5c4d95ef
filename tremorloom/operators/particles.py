"""Non-linear state of particles over sections: evidence from each event depends on the state that it meets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorloom.operators.traces import UNDERFLOW

#: Sections of one list of alike ones, on average at most; sections of a bin that meet others in one task.
GROUP_ROWS, BIN_ROWS = 256, 1_024


def assimilate_regions(states: DataFrame, events: DataFrame, loading: np.ndarray, gain: float, release: float, exponent: float, reference: float) -> DataFrame:
    """(region, particle, day, section, margin) after each day with events. states: (region, particle, section, margin), sections from 0.

    events: (region, day, order, event_id, magnitude, probability, section, weight), a row for each section that an event may be
    of. A day first loads every section, then takes its events in order: each adds evidence that falls with the margin it meets and
    takes away a release that grows with magnitude; at the day's end the margins are centred. Where states have a column active,
    only active sections change and count for the centre. Rows without a section or magnitude count for nothing but their day.
    Particles are one axis of a region's array: events meet a region by key and are not copied. A task holds one region.
    """
    masked = "active" in states.columns

    def run(s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if s.empty or e.empty:
            return pd.DataFrame({"region": np.zeros(0, object), "particle": np.zeros(0, np.int64), "day": np.zeros(0, np.int32), "section": np.zeros(0, np.int32), "margin": np.zeros(0)})
        table = s.pivot(index="particle", columns="section", values="margin").sort_index()
        margin = table.to_numpy(float).copy()
        active = s.pivot(index="particle", columns="section", values="active").sort_index().to_numpy(bool) if masked else np.ones(margin.shape, bool)
        count, out = active.sum(axis=1, keepdims=True), []
        for day, group in e.sort_values(["day", "order", "event_id"], kind="stable").groupby("day"):
            margin = margin + np.where(active, loading, 0.0)
            known = group[group["at"].notna() & group["magnitude"].notna()]
            for (_, _, magnitude, probability), rows in known.groupby(["order", "event_id", "magnitude", "probability"], sort=False):
                at, w = rows["at"].to_numpy(int), rows["weight"].to_numpy(float)
                change = gain * probability * w / (1 + np.exp(margin[:, at])) - release * 10 ** (exponent * (magnitude - reference)) * w
                np.add.at(margin, (slice(None), at), np.where(active[:, at], change, 0.0))
            centre = np.where(active, margin, 0.0).sum(axis=1, keepdims=True) / np.maximum(count, 1)
            margin = np.where(active, margin - centre, margin)
            out.append((int(day), margin))
        n, days = margin.size, np.array([d for d, _ in out])
        return pd.DataFrame(
            {
                "region": np.full(n * len(out), s["region"].iloc[0], object),
                "particle": np.tile(np.repeat(table.index.to_numpy(), margin.shape[1]), len(out)),
                "day": np.repeat(days, n),
                "section": np.tile(table.columns.to_numpy(), len(margin) * len(out)),
                "margin": np.concatenate([m.ravel() for _, m in out]),
            }
        )

    slim = events.select(F.col("region").alias("of"), "day", "order", "event_id", "magnitude", "probability", F.col("section").alias("at"), "weight")
    met = states.groupBy("region").cogroup(slim.groupBy("of"))
    return met.applyInPandas(run, "region string, particle long, day int, section int, margin double")


def centred_loading(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value centred and scaled to unit root mean square within keys."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    centred = rows.withColumn("_c", F.col(value) - F.avg(value).over(w))
    return centred.withColumn("loading", F.col("_c") / F.sqrt(F.avg(F.col("_c") * F.col("_c")).over(w))).drop("_c")


def coupling(sections: DataFrame, length: float, floor: float, reach: float | None = None) -> DataFrame:
    """(src, dst, weight) of a symmetric section graph. sections: (section, sx, sy, strike, model).

    Weight falls with distance as a Gaussian and with the angle between strikes; sections of different models are not joined.
    Sections meet in square bins of the reach and their neighbours, so far pairs are never formed. Without a reach the graph is
    whole: beyond UNDERFLOW lengths weights are 0.
    """
    return each_pair(coupled_lists(sections, length, floor, reach))


def each_pair(lists: DataFrame) -> DataFrame:
    """(src, dst, weight) of all pairs of different sections of coupled lists (srcs, dsts, weight)."""
    return lists.select(F.explode("srcs").alias("src"), "dsts", "weight").select("src", F.explode("dsts").alias("dst"), "weight").where("src != dst")


def coupled_lists(sections: DataFrame, length: float, floor: float, reach: float | None = None) -> DataFrame:
    """(srcs, dsts, weight) of coupling, for lists of sections that have one weight.

    Sections of one place, strike and model meet others as one, in lists of some
    GROUP_ROWS, so a weight is found once for all pairs of two lists; a busy bin is dealt to several tasks.
    """
    reach = UNDERFLOW * length if reach is None else reach
    alike = ["sx", "sy", "strike", "model"]
    most = sections.groupBy(*alike).count().agg(F.max("count")).first()[0] or 1
    piece = F.pmod(F.xxhash64("section"), F.lit(-(-most // GROUP_ROWS))).alias("_piece")
    lists = sections.groupBy(*alike, piece).agg(F.collect_list("section").alias("members"))
    binned = lists.withColumns({"bx": F.floor(F.col("sx") / reach), "by": F.floor(F.col("sy") / reach)})
    busiest = sections.groupBy("model", F.floor(F.col("sx") / reach), F.floor(F.col("sy") / reach)).count().agg(F.max("count")).first()[0] or 1
    salts = min(-(-busiest // BIN_ROWS), 4 * int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    salt = F.pmod(F.xxhash64("sx", "sy", "strike", "_piece"), F.lit(salts)).cast("int").alias("salt")
    left = binned.select("*", around.alias("o")).select(F.col("members").alias("srcs"), F.col("sx").alias("ax"), F.col("sy").alias("ay"), F.col("strike").alias("a"), "model", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"), salt)
    right = binned.select(F.col("members").alias("dsts"), F.col("sx").alias("cx"), F.col("sy").alias("cy"), F.col("strike").alias("c"), "model", "bx", "by", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    d2 = F.pow(F.col("ax") - F.col("cx"), 2) + F.pow(F.col("ay") - F.col("cy"), 2)
    aligned = floor + (1 - floor) * F.pow(F.cos(F.radians(F.col("a") - F.col("c"))), 2)
    key, tasks = ["model", "bx", "by", "salt"], 4 * int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of tasks of its own: lists are few bytes, but many pairs
    met = left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key).where(d2 <= reach**2)
    return met.select("srcs", "dsts", (F.exp(-0.5 * d2 / length**2) * aligned).alias("weight"))
