"""Sections of one place, strike and model share a weight; every pair of them has its row."""

import math

import pytest
from pyspark.sql import functions as F

from tremorloom.operators import particles


@pytest.mark.parametrize("rows", [3, 256])
def test_coupling_of_copies(spark, monkeypatch, rows):
    monkeypatch.setattr(particles, "GROUP_ROWS", rows, raising=False)
    monkeypatch.setattr(particles, "BIN_ROWS", rows, raising=False)
    every = [(i, float(i % 4), float(i % 3) / 2, float(i % 2 * 40), i % 2) for i in range(120)]
    sections = spark.createDataFrame(every, "section long, sx double, sy double, strike double, model int")
    graph = particles.coupling(sections, 1.5, 0.3, 2.0)
    got = {(r.src, r.dst): r.weight for r in graph.collect()}
    want = {}
    for s, ax, ay, a, m in every:
        for t, bx, by, b, n in every:
            d2 = (ax - bx) ** 2 + (ay - by) ** 2
            if s != t and m == n and d2 <= 4:
                want[s, t] = math.exp(-0.5 * d2 / 2.25) * (0.3 + 0.7 * math.cos(math.radians(a - b)) ** 2)
    assert got.keys() == want.keys() and graph.count() == len(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    joined = graph._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "explode(srcs" in joined and "explode(dsts" in joined  # pairs of sections are formed above the join, not in it
    assert particles.coupling(sections.where(F.lit(False)), 1.5, 0.3, 2.0).count() == 0
