"""Continuations: reproducible however rows are dealt, with the means and variances of a plain loop; places uniform in a polygon."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorloom.functions import kernels, special
from tremorloom.functions.region import SphericalPolygon, Square
from tremorloom.operators import simulate
from tremorloom.plans import simulation
from tremorloom.plans.point_process import cat

PARAMETERS = kernels.Parameters(0.02, 2e-3, 1.1, 0.01, 0.1, 100.0, 0.2, 0.8, 0.6)
BETA = 2.3
PLANE = Square(10.0)


def history(n=800, seed=5):
    rng = np.random.default_rng(seed)
    h = pd.DataFrame({"event_id": np.arange(n), "age": rng.random(n) * 7, "lon": rng.random(n) * 10, "lat": rng.random(n) * 10, "mag": rng.exponential(1 / BETA, n)})
    h.loc[0, ["age", "mag"]] = 0.001, 4.5  # bears most offspring
    return h


def frame(df):
    return df.toPandas().sort_values(["catalog", "t", "x"]).reset_index(drop=True)


def plain(h, p, days, rng):
    """One continuation by a loop over generations; counts of roots, first generation and all that lie inside."""
    n = rng.poisson(p.mu * 100 * days)
    parents = np.vstack((np.column_stack((-h["age"], h[["lon", "lat", "mag"]])), np.column_stack((rng.random(n) * days, rng.random((n, 2)) * 10, rng.exponential(1 / BETA, n)))))
    inside = n
    while len(parents):
        count = rng.poisson(simulate.expected_offspring(parents[:, 0], parents[:, 3], p, 0.0, days))
        of = np.repeat(np.arange(len(parents)), count)
        if not len(of):
            return inside
        low, high = np.maximum(0.0, -parents[of, 0]), days - parents[of, 0]
        grid = np.geomspace(p.c, 50 * p.tau, 4000) - p.c
        mass = np.concatenate(([0.0], np.cumsum(special.temporal_integral(grid[:-1], grid[1:], p))))
        a, b = np.interp(low, grid, mass), np.interp(high, grid, mass)
        t = parents[of, 0] + np.interp(a + rng.random(len(of)) * (b - a), mass, grid)
        r = np.sqrt(p.d * np.exp(p.gamma * parents[of, 3]) * (rng.random(len(of)) ** (-1 / p.rho) - 1))
        turn = rng.random(len(of)) * 2 * np.pi
        parents = np.column_stack((t, parents[of, 1] + r * np.sin(turn), parents[of, 2] + r * np.cos(turn), rng.exponential(1 / BETA, len(of))))
        inside += int(PLANE.inside(parents[:, 1], parents[:, 2]).sum())
    return inside


def test_same_however_dealt_and_prefix_stable(spark):
    h = history()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for parts, n in (("1", 40), ("6", 40), ("4", 100)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(frame(simulate.continuations(spark.createDataFrame(h).repartition(int(parts)), PARAMETERS, 0.0, BETA, PARAMETERS.mu, PLANE, simulations=n)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    pd.testing.assert_frame_equal(got[0], got[1])
    pd.testing.assert_frame_equal(got[0], got[2][got[2]["catalog"] < 40].reset_index(drop=True))
    other = frame(simulate.continuations(spark.createDataFrame(h), PARAMETERS, 0.0, BETA, PARAMETERS.mu, PLANE, simulations=40, seed=2))
    assert len(other) != len(got[0]) or (other["t"] != got[0]["t"]).any()


def test_counts_have_the_mean_and_variance_of_a_loop(spark):
    h, n = history(), 600
    got = simulate.continuations(spark.createDataFrame(h), PARAMETERS, 0.0, BETA, PARAMETERS.mu, PLANE, simulations=n).groupBy("catalog").count().toPandas()["count"].to_numpy()
    got = np.concatenate((got, np.zeros(n - len(got))))
    rng = np.random.default_rng(3)
    want = np.array([plain(h, PARAMETERS, 1.0, rng) for _ in range(n)])
    assert abs(got.mean() - want.mean()) < 4.5 * math.sqrt((got.var() + want.var()) / n)
    assert 0.7 < got.var() / want.var() < 1.4


def test_first_generation_means_by_cell_are_closed_form(spark):
    h, n = history(), 4000
    still = kernels.Parameters(1e-9, 2e-3, 1.1, 0.01, 0.1, 100.0, 1e-12, 0.0, 0.6)  # offspring stay where they are born
    still = kernels.Parameters(1e-9, 2e-3 * (still.d / 0.2) ** still.rho, still.a, still.c, still.omega, still.tau, still.d, 0.0, still.rho)
    got = simulate.continuations(spark.createDataFrame(h), still, 0.0, BETA, 0.0, PLANE, simulations=n, generations=1)
    cells = got.groupBy((F.floor("y") * 10 + F.floor("x")).cast("int").alias("cell")).count().toPandas().set_index("cell")["count"]
    mean = still.k0 * np.exp(still.a * h["mag"]) * np.pi / still.rho * still.d**-still.rho * special.temporal_integral(h["age"].to_numpy(), h["age"].to_numpy() + 1, still)
    want = mean.groupby((np.floor(h["lat"]) * 10 + np.floor(h["lon"])).astype(int)).sum() * n
    assert abs(cells.sum() - want.sum()) < 5 * math.sqrt(want.sum())
    for cell, m in want.items():
        assert abs(cells.get(cell, 0) - m) < 5.5 * math.sqrt(m) + 2
    each = got.where("floor(x) = {} AND floor(y) = {}".format(*np.floor(h.loc[0, ["lon", "lat"]]).astype(int))).groupBy("catalog").count().toPandas()["count"]
    per = np.concatenate((each, np.zeros(n - len(each))))
    assert 0.85 < per.var() / per.mean() < 1.15  # Poisson over simulations, though one event bears them in many pieces


def test_places_are_uniform_on_the_sphere(spark):
    across = SphericalPolygon([(170, -60), (200, -60), (200, 60), (185, 70), (170, 60)], 2.0)
    got = simulate.roots(spark, 40_000 / across.area, 0.0, BETA, across, simulations=1).toPandas()
    assert abs(len(got) - 40_000) < 5 * 200 and got["x"].between(-180, 180).all() and (got["x"] < 0).any() and (got["x"] > 0).any()
    assert across.inside(got["x"].to_numpy(), got["y"].to_numpy()).all() and got["t"].between(0, 1).all()
    for low in range(-60, 60, 20):
        strip = SphericalPolygon([(170, low), (200, low), (200, low + 20), (170, low + 20)], 2.0).area / across.area * len(got)
        assert abs(got["y"].between(low, low + 20).sum() - strip) < 5 * math.sqrt(strip)
    assert SphericalPolygon([(0, 0), (360, 0), (360, 90), (0, 90)], 3.0).area == pytest.approx(2 * math.pi * 9)
    with pytest.raises(ValueError, match="vertices"):
        SphericalPolygon([(0, 0), (1, 1)], 1.0)


def test_great_circles_and_edges():
    area = SphericalPolygon([(0, 0), (10, 0), (10, 10), (0, 10)], 6371.0)
    x, y = area.moved(np.array([0.0, 179.9, 0.0]), np.array([0.0, 0.0, 80.0]), np.array([6371.0 * math.pi / 2, 100.0, 6371.0 * math.radians(20)]), np.array([0.0, math.pi / 2, 0.0]))
    assert y[0] == pytest.approx(90) and x[1] == pytest.approx(-180 + math.degrees(100 / 6371.0) - 0.1) and y[2] == pytest.approx(80)
    assert area.inside(np.array([0.0, 10.0, 5.0, 10.1, 365.0]), np.array([5.0, 10.0, 0.0, 5.0, 5.0])).tolist() == [True, True, True, False, True]


def test_supercritical_and_useless_rows(spark):
    h = spark.createDataFrame([(1, -0.5, 1.0, 1.0, 3.0), (2, None, 1.0, 1.0, 3.0), (3, 1.0, None, 1.0, 3.0)], "event_id long, age double, lon double, lat double, mag double")
    assert simulate.continuations(h, PARAMETERS, 0.0, BETA, 0.0, PLANE, simulations=50).count() == 0
    assert simulate.continuations(h.where("false"), PARAMETERS, 0.0, BETA, 0.0, PLANE).count() == 0
    wild = kernels.Parameters(0.02, 2e-2, 1.1, 0.01, 0.1, 100.0, 0.2, 0.8, 0.6)
    assert simulate.offspring_ratio(wild, BETA, 1.0) > 1 > simulate.offspring_ratio(PARAMETERS, BETA, 1.0)
    with pytest.raises(ValueError, match="die out"):
        simulate.continuations(h, wild, 0.0, BETA, 0.0, PLANE)
    assert simulate.continuations(h, wild, 0.0, BETA, 0.0, PLANE, simulations=10, generations=2).count() == 0


def test_simulate_grid_takes_the_whole_week(spark, monkeypatch):
    taken = []
    whole = simulate.continuations
    monkeypatch.setattr(simulate, "continuations", lambda h, *a, **k: taken.append(h.count()) or whole(h, *a, **k))
    path = "/root/testdata/sf0.01"
    simulation.simulate_grid(spark, path)
    assert taken == [cat(spark, path).where("day > 19745").count()] and taken[0] > 2000


def test_rates_keep_the_exact_background(spark):
    rows = spark.createDataFrame([(0, 0.5, 0.5, 0.5, 1.0, True), (0, 0.5, 0.5, 0.5, 1.0, False), (3, 0.5, 1.5, 0.5, 1.0, False)], simulate.SCHEMA)
    background = spark.createDataFrame([(0, 0.25), (1, 0.5), (2, 0.75)], "cell int, mass double")
    got = {r["cell"]: r["rate"] for r in simulate.expected_rates(rows, background, (F.floor("y") * 10 + F.floor("x")).cast("int"), 4).collect()}
    assert got == {0: 0.5, 1: 0.75, 2: 0.75}
