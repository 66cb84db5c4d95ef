"""Recurrences along sorted rows: state before each row of S <- max(least, a S + b), in time linear in the rows.

Such steps compose to steps of the same form, so rows are sorted by range once, each range is run through from an unknown state,
and the driver passes the state on from range to range: one short row for each. Series of any length, also one that holds most
rows, are cut wherever the ranges end, and no series is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tremorloom.session import cut


@dataclass(frozen=True)
class Step:
    """S <- max(least, decay * S + gain) at a row; a series begins at start. Null decay or gain leave the state as it is."""

    decay: Column
    gain: Column
    start: Column
    least: float | None = None


def _after(later: tuple, earlier: tuple) -> tuple:
    """The step that takes `earlier` and then `later`: (decay, gain, least)."""
    a2, b2, c2 = later
    a1, b1, c1 = earlier
    with np.errstate(invalid="ignore"):
        return a2 * a1, a2 * b1 + b2, np.maximum(c2, np.where(np.isneginf(c1), -np.inf, a2 * c1 + b2))


def _run(steps: tuple) -> tuple:
    """Running composition along the rows, by doubling."""
    n, reach = steps[0].shape[0], 1
    steps = tuple(x.copy() for x in steps)
    while reach < n:
        joined = _after(tuple(x[reach:] for x in steps), tuple(x[:-reach] for x in steps))
        for x, y in zip(steps, joined, strict=True):
            x[reach:] = y
        reach *= 2
    return steps


class _Range:
    """Runs through the batches of one sorted range, each state as a step that takes the state at the range's begin."""

    def __init__(self, keys: list[str], n: int) -> None:
        self.keys, self.n = keys, n
        self.last_key: tuple | None = None
        self.pending = tuple(np.full((1, n), v) for v in (1.0, 0.0, -np.inf))  # state before the next row, if its series goes on

    def key(self, pdf: pd.DataFrame, row: int) -> tuple:
        return tuple(None if pd.isna(v := pdf[k].iloc[row]) else v for k in self.keys)

    def feed(self, pdf: pd.DataFrame) -> tuple[tuple, np.ndarray]:
        """(step from the range's begin to before each row), and which rows begin a series."""
        block = lambda name: np.column_stack([pdf[f"_{name}{i}"].to_numpy(float) for i in range(self.n)])
        a, b, c, s = (block(x) for x in "abcs")
        fresh = np.zeros(len(pdf), bool)
        for k in self.keys:
            v = pdf[k]
            fresh |= ((v != v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy()
        fresh[0] = self.last_key is not None and self.key(pdf, 0) != self.last_key
        into = tuple(np.concatenate((p, x[:-1])) for p, x in zip(self.pending, (a, b, c), strict=True))
        into = (np.where(fresh[:, None], 0.0, into[0]), np.where(fresh[:, None], s, into[1]), np.where(fresh[:, None], -np.inf, into[2]))
        before = _run(into)
        self.pending = _after(tuple(x[-1:] for x in (a, b, c)), tuple(x[-1:] for x in before))
        self.last_key = self.key(pdf, len(pdf) - 1)
        return before, fresh


def scanned(rows: DataFrame, keys: list[str], at: str, steps: Mapping[str, Step]) -> DataFrame:
    """rows with, for each named step, the state before the row, in the order of `at` within keys; at is unique within keys."""
    names, n = list(steps), len(steps)
    extra = {}
    for i, step in enumerate(steps.values()):
        extra |= {f"_a{i}": F.coalesce(step.decay.cast("double"), F.lit(1.0)), f"_b{i}": F.coalesce(step.gain.cast("double"), F.lit(0.0)), f"_s{i}": step.start.cast("double"), f"_c{i}": F.lit(float("-inf") if step.least is None else step.least)}
    spark, helpers = rows.sparkSession, [*extra, "_part"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns(extra).repartitionByRange(parts, *keys, at).sortWithinPartitions(*keys, at)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, first, start, over, part = _Range(keys, n), None, None, False, None
        for pdf in batches:
            if not len(pdf):
                continue
            if first is None:
                first, part = run.key(pdf, 0), int(pdf["_part"].iloc[0])
                start = [float(pdf[f"_s{i}"].iloc[0]) for i in range(n)]
            _, fresh = run.feed(pdf)
            over |= bool(fresh.any())
        if first is not None:
            yield pd.DataFrame({"part": [part], "first": [repr(first)], "last": [repr(run.last_key)], "whole": [not over], "start": [start], **{x: [run.pending[i][0].tolist()] for i, x in enumerate(("decay", "gain", "least"))}})

    slim = dealt.select(*keys, "_part", *extra)
    kind = "array<double>"
    found = slim.mapInPandas(ends, f"part int, first string, last string, whole boolean, start {kind}, decay {kind}, gain {kind}, least {kind}").collect()  # one row a range
    begins, key, state = {}, None, None
    for r in sorted(found, key=lambda r: r["part"]):
        begins[r["part"]] = np.array(state if r["first"] == key else r["start"])
        state, key = np.maximum(r["least"], np.array(r["decay"]) * begins[r["part"]] + r["gain"]), r["last"]

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = _Range(keys, n)
        for pdf in batches:
            if len(pdf):
                (a, b, c), _ = run.feed(pdf)
                x = np.maximum(c, a * begins[int(pdf["_part"].iloc[0])] + b)
                yield pdf.drop(columns=helpers).assign(**{name: x[:, i] for i, name in enumerate(names)})

    schema = StructType([*rows.schema.fields, *(StructField(name, DoubleType()) for name in names)])
    return dealt.mapInPandas(states, schema)
