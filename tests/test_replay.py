"""Scans and replays against loops: long series, one that holds most rows, ranges that end inside a series, members, errors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorloom.functions import kernels, special
from tremorloom.operators import replay, scoring, state
from tremorloom.operators.scan import Step, scanned


def series(seed=3):
    rng = random.Random(seed)
    rows = [("hot", d, rng.random(), rng.uniform(-1, 1)) for d in range(8000)]
    rows += [(k, d, rng.random(), rng.uniform(-1, 1)) for k in ("a", "b", None, "z") for d in range(rng.randint(1, 300))]
    rows += [("gap", d, None, None if d % 2 else 0.5) for d in range(0, 900, 9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", ["1", "7"])
def test_scan_equals_a_loop(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        rows = series()
        df = spark.createDataFrame(rows, "k string, d int, a double, b double").repartition(5)
        steps = {"line": Step(F.col("a"), F.col("b"), F.when(F.col("k") == "a", 4.0).otherwise(1.0)), "clip": Step(F.lit(0.9), F.col("b"), F.lit(0.0), 0.0)}
        got = {(r["k"], r["d"]): (r["line"], r["clip"]) for r in scanned(df, ["k"], "d", steps).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    last = None
    for k, d, a, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if k != last or d == 0:
            line, clip = 4.0 if k == "a" else 1.0, 0.0
        assert abs(got[k, d][0] - line) < 1e-9 and abs(got[k, d][1] - clip) < 1e-9
        line = (1.0 if a is None else a) * line + (b or 0.0)
        clip, last = max(0.0, 0.9 * clip + (b or 0.0)), k


def test_cusum_and_age_of_many_days(spark):
    rng = random.Random(1)
    seen = {(c, d): rng.choice([0.0, 0.0, 0.0, 0.7]) for c in range(3) for d in range(8000)}
    df = spark.createDataFrame([(c, d, v) for (c, d), v in seen.items()], "cell int, day int, o double")
    ages = {(r["cell"], r["day"]): r["state"] for r in state.hazard_age(df, ["cell"], "day", 0.02, "o").collect()}
    sums = {(r["cell"], r["day"]): (r["state"], r["variance"]) for r in state.cusum(df, ["cell"], "day", F.col("o"), F.lit(0.1), 0.95).collect()}
    for c in range(3):
        age, s, v = 0.0, 0.0, 0.0
        for d in range(8000):
            assert abs(ages[c, d] - age) < 1e-9 and abs(sums[c, d][0] - s) < 1e-9 and abs(sums[c, d][1] - v) < 1e-9
            age, s, v = (age + 0.02) * math.exp(-seen[c, d]), max(0.0, 0.95 * s + seen[c, d] - 0.1), 0.9025 * v + 0.1


CLOCK = replay.Clock(full=3.0, exponent=0.5, mix=0.4, aperiodicity=0.6, consensus=0.2, fraction=0.7, sensitivity=0.9)
FRAILTY = replay.Frailty(0.8, 0.6, 1.5, 20.0, 0.3, 0.02, 0.5)
PHASE = replay.Phase(3.0, 11.0, 0.001, 0.5, 1.2)
TAIL = replay.Tail(2.0, 1.0)


def inputs(spark, days=400):
    rng = random.Random(8)
    cells = [(c, rng.uniform(0.01, 0.2), rng.uniform(0.5, 2)) for c in range(6)]
    geometry = [(b, c, s, 0.3) for b in range(2) for c in range(6) for s in ((c + b) % 5, (c + 2) % 5) if (b, s) != (1, 3)]
    geometry = list({(b, c, s): (b, c, s, p) for b, c, s, p in geometry}.values())
    graph = [(b, s, (s + 1) % 5, 0.25) for b in range(2) for s in range(4)] + [(b, s, (s + 2) % 5, 0.75) for b in range(2) for s in range(4)]
    graph = [g for g in graph if (g[0], g[1]) != (1, 3) and (g[0], g[2]) != (1, 3)]
    weight = {}
    for b, s, _, w in graph:
        weight[b, s] = weight.get((b, s), 0) + w
    graph = [(b, s, t, w / weight[b, s]) for b, s, t, w in graph]
    events = [(i, rng.randrange(days), rng.randrange(6), 1 + rng.expovariate(2), rng.uniform(0.5, 3), rng.random()) for i in range(300)]
    expected = {}
    for b, c, s, p in geometry:
        expected[b, s] = expected.get((b, s), 0) + p * cells[c][1]
    placed = [(b, e[0], s, p) for e in events for b, c, s, p in geometry if c == e[2]]
    tables = {
        "expected": spark.createDataFrame([(*k, v) for k, v in expected.items()], "branch int, section int, mass double"),
        "events": spark.createDataFrame(events, "event_id int, day int, cell int, magnitude double, rate double, share double"),
        "placed": spark.createDataFrame(placed, "branch int, event_id int, section int, p double"),
        "graph": spark.createDataFrame(graph, "branch int, src int, dst int, weight double"),
        "geometry": spark.createDataFrame(geometry, "branch int, cell int, section int, p double"),
        "cells": spark.createDataFrame(cells, "cell int, mass double, area double"),
    }
    return tables, (cells, geometry, graph, events, expected)


def by_loop(raw, days, start, ablation, ages):
    """One pass over the days that keeps arrays of all branches and sections."""
    cells, geometry, graph, events, expected = raw
    mass = np.zeros((2, 5))
    for (b, s), v in expected.items():
        mass[b, s] = v
    g = np.zeros((2, 5, 5))
    for b, s, t, w in graph:
        g[b, s, t] = w
    for b in range(2):
        for s in range(5):
            if not g[b, s].any():
                g[b, s, s] = 1.0
    p = np.zeros((2, 6, 5))
    for b, c, s, x in geometry:
        p[b, c, s] = x
    background, area = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
    h = kernels.expected_reset_weight(TAIL.beta, TAIL.reference, CLOCK.full, CLOCK.exponent)
    age, ex, ro, fast, slow = ages.copy(), *(np.zeros((2, 5)) for _ in range(4))
    r, q1, q2 = 0.5 ** (1 / FRAILTY.half_life), 0.5 ** (1 / PHASE.short), 0.5 ** (1 / PHASE.long)
    known, out, active = np.array([[(b, s) in expected for s in range(5)] for b in range(2)]), {}, 0
    for day in range(days):
        today = [e for e in events if e[1] == day]
        frail = np.log((ro + FRAILTY.prior) / (ex + FRAILTY.prior))
        fast, slow = q1 * fast + (1 - q1) * frail, q2 * slow + (1 - q2) * frail
        faster = np.maximum(fast - slow - PHASE.floor, 0)
        if today and day >= start:
            scores = np.zeros((2, 6))
            for b in range(2):
                overdue = special.overdue((1 - CLOCK.mix) * age[b] + CLOCK.mix * g[b] @ age[b], CLOCK.aperiodicity)
                excess = np.maximum((1 - FRAILTY.mix) * frail[b] + FRAILTY.mix * g[b] @ frail[b] - FRAILTY.floor, 0)
                debt = np.cbrt(overdue * (1 if ablation == "frailty_level_removed" else excess) * (1 if ablation == "acceleration_removed" else faster[b]))
                mix = 0 if ablation == "network_coherence_removed" else PHASE.coherence
                phase = (1 - mix) * debt + mix * np.sqrt(debt * (g[b] @ debt))
                scores[b] = p[b] @ ((FRAILTY.overdue_weight * overdue + FRAILTY.frailty_weight * excess + PHASE.weight * phase) * known[b])
            share = (scores > 0).mean(0)
            score = scores.mean(0) * np.clip((share - CLOCK.consensus) / (1 - CLOCK.consensus), 0, 1)
            active += bool((score > 0).any())
            tilt = background * np.exp(np.minimum(score, 4))
            mixed = background if not score.any() else ((1 - FRAILTY.fraction) * background / background.sum() + FRAILTY.fraction * tilt / tilt.sum()) * background.sum()
            for e in today:
                out[e[0]] = e[4] + (mixed[e[2]] - background[e[2]]) / area[e[2]]
        seen, marked = np.zeros((2, 5)), np.zeros((2, 5))
        for e in today:
            mark = min(1.0, 10 ** (CLOCK.exponent * (e[3] - CLOCK.full)))
            seen += e[5] * p[:, e[2], :]
            marked += e[5] * mark * p[:, e[2], :]
        age, ex, ro = (age + h * mass) * np.exp(-marked), r * ex + mass, r * ro + seen
    return out, active


@pytest.mark.parametrize("ablation", ["full", "acceleration_removed", "network_coherence_removed"])
def test_replay_equals_a_loop(spark, ablation):
    tables, raw = inputs(spark)
    found, days = replay.evaluated(**tables, first=0, end=400, clock=CLOCK, tail=TAIL, frailty=FRAILTY, phase=PHASE, ablation=ablation, scoring_start=30, branches=2)
    want, active = by_loop(raw, 400, 30, ablation, np.zeros((2, 5)))
    rows = found.collect()
    assert {r["event_id"] for r in rows} == want.keys() and len(rows) == len(want)
    assert all(abs(r["challenger"] - want[r["event_id"]]) < 1e-9 and abs(r["gain"] - math.log(r["challenger"] / r["rate"])) < 1e-12 for r in rows)
    assert days.where("active").count() == active > 0


def test_members_are_averaged_as_rates(spark):
    tables, raw = inputs(spark, 60)
    ages = [(m, b, s, 0.1 + m * 0.9 + 0.05 * s) for m in range(3) for b, s in raw[4]]
    got = replay.evaluated(**tables, first=0, end=60, clock=CLOCK, tail=TAIL, frailty=FRAILTY, phase=PHASE, branches=2, ages=spark.createDataFrame(ages, "member int, branch int, section int, age double"))[0].collect()
    each = []
    for m in range(3):
        start = np.zeros((2, 5))
        for k, b, s, a in ages:
            if k == m:
                start[b, s] = a
        each.append(by_loop(raw, 60, 0, "full", start)[0])
    assert got and all(abs(r["challenger"] - np.mean([e[r["event_id"]] for e in each])) < 1e-9 for r in got)


def test_errors(spark):
    tables, _ = inputs(spark, 20)
    with pytest.raises(ValueError, match="unknown ablation"):
        replay.evaluated(**tables, first=0, end=20, clock=CLOCK, tail=TAIL, frailty=FRAILTY, phase=PHASE, ablation="none", branches=2)
    with pytest.raises(ValueError, match="positive"):
        replay.exposure_scale(tables["cells"].withColumn("mass", F.lit(0.0)), 10.0)
    assert abs(replay.exposure_scale(spark.createDataFrame([(1, 0.2), (2, 0.4)], "cell int, mass double"), 10.0, 3.0) - 1.0) < 1e-12


def test_overdue_at_great_ages():
    """The hazard of the inverse Gaussian tends to half its shape."""
    ages = np.array([50.0, 400.0, 3000.0, 1e5])
    got = special.overdue(ages, 0.5)
    assert (np.diff(got) < 0).all() or np.isfinite(got).all()
    assert abs(got[-1] - math.log(2.0)) < 1e-3 and np.abs(np.diff(got)).max() < 0.1


def test_criticality_and_rejections(spark):
    rows = spark.createDataFrame([(k, d, 0.1 * k, float(d % 3 == 0), 0.05 * d) for k in range(3) for d in range(50)], "k int, day int, load double, release double, transfer double")
    got = {(r["k"], r["day"]): r["state"] for r in state.criticality(rows, ["k"], "day", F.col("load"), F.col("release"), F.col("transfer"), 2.0, 0.5).collect()}
    for k in range(3):
        m = 0.5
        for d in range(50):
            assert abs(got[k, d] - m) < 1e-12
            m += 0.2 * k - float(d % 3 == 0) + 0.05 * d
    with pytest.raises(Exception, match="negative"):
        state.criticality(rows, ["k"], "day", F.col("load"), F.lit(-1.0), F.col("transfer")).collect()
    tests = spark.createDataFrame([("n", [0.01, 0.99]), ("m", [0.03, 0.99]), ("s", [0.01]), ("t", [0.99]), ("u", [0.5]), ("v", [None]), ("w", None), ("x", [None, 0.01])], "name string, quantiles array<double>")
    assert {r["name"]: r["rejected"] for r in scoring.rejections(tests, 0.025).collect()} == {"n": True, "m": False, "s": True, "t": True, "u": False, "v": False, "w": False, "x": True}


def test_graph_coherent(spark):
    rows = spark.createDataFrame([(0, 0, s, 1, float(s)) for s in range(4)], "member long, branch int, section int, day int, z double")
    graph = spark.createDataFrame([(0, 0, 3, 1.0), (0, 3, 0, 0.5), (0, 3, 2, 0.5)], "branch int, src int, dst int, weight double")
    got = {r["section"]: r["coherent"] for r in replay.graph_coherent(rows, graph, "z", 0.5).collect()}
    assert got == pytest.approx({0: 0.0, 1: 0.5, 2: 1.5, 3: math.sqrt(2.5 * 0.5)})
