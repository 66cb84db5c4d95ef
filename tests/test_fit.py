"""The tilt's gradient against finite differences, fits against known optima and bounds; Sobol designs by their stratification."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorloom.operators import designs, fit

NAMES = ["a", "b", "c"]


def rows(spark, n=4000, seed=2, truth=(0.8, -0.5, 0.0)):
    rng = np.random.default_rng(seed)
    x = np.clip(rng.normal(size=(n, 3)), -3, 3)
    day, rate = np.arange(n) % 40, rng.uniform(0.1, 2, n)
    target = rng.poisson(rate * np.exp(x @ np.array(truth)))
    return spark.createDataFrame(pd.DataFrame({"day": day, "rate": rate, "target": target, **dict(zip(NAMES, x.T, strict=True))})).repartition(3), (day, rate, target, x)


def plain(raw, w):
    day, rate, target, x = raw
    o, gain, gradient = x @ w, 0.0, np.zeros(3)
    for d in np.unique(day):
        m = day == d
        p = rate[m] * np.exp(o[m] - o[m].max())
        gain += (target[m] * o[m]).sum() - target[m].sum() * (o[m].max() + math.log(p.sum()) - math.log(rate[m].sum()))
        gradient += ((target[m] - target[m].sum() * p / p.sum())[:, None] * x[m]).sum(0)
    return gain, gradient


def test_value_and_gradient(spark):
    df, raw = rows(spark)
    o = fit.Objective(df.cache(), NAMES, 3.0, 0.1)
    w = np.array([0.4, -0.2, 0.1])
    gain, gradient, events = o.gain(w)
    want = plain(raw, w)
    assert gain == pytest.approx(want[0], rel=1e-10) and gradient == pytest.approx(want[1], rel=1e-9, abs=1e-8) and events == raw[2].sum()
    value, slope = o(w)
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        assert slope[i] == pytest.approx((o(w + step)[0] - o(w - step)[0]) / 2e-5, rel=1e-5, abs=1e-7)
    before = o.evaluations
    assert o(w)[0] == value and o.evaluations == before
    steep = np.array([60.0, -60.0, 60.0])  # far beyond what exp alone could hold less its bound
    assert o.gain(steep)[0] == pytest.approx(plain(raw, steep)[0], rel=1e-9)
    with pytest.raises(ValueError, match="steep"):
        o.gain([300.0, 0.0, 0.0])
    row = o.days(w).agg(F.sum("gain")).first()[0]
    assert row == pytest.approx(gain)
    ratios = fit.log_ratios(df, dict(zip(NAMES, w, strict=True)))
    assert ratios.agg(F.sum(F.col("target") * F.col("log_ratio"))).first()[0] == pytest.approx(gain)


def test_fit_finds_the_truth_and_keeps_the_box(spark):
    df, raw = rows(spark)
    o = fit.Objective(df.cache(), NAMES, 3.0)
    w = fit.minimized(o, [0.0] * 3, -2.0, 2.0)
    assert w == pytest.approx([0.8, -0.5, 0.0], abs=0.06) and np.abs(o(w)[1]).max() < 1e-6
    tight = fit.minimized(o, [0.0] * 3, -0.3, 0.3)
    assert tight[0] == 0.3 and tight[1] == -0.3 and abs(o(tight)[1][2]) < 1e-6 and o(tight)[1][0] < 0 < o(tight)[1][1]
    s = fit.summary(o.days(w)).first()
    assert s["events"] == raw[2].sum() and s["gain"] == pytest.approx(plain(raw, w)[0]) and s["positive_days"] + s["negative_days"] <= 40


def test_minimized_on_a_valley_and_errors():
    rosenbrock = lambda x: (float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2), np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    assert fit.minimized(rosenbrock, [-1.2, 1.0], -5, 5, steps=200) == pytest.approx([1, 1], abs=1e-5)
    assert fit.minimized(rosenbrock, [-1.2, 1.0], -2, 0.5, steps=200) == pytest.approx([0.5, 0.25], abs=1e-5)
    with pytest.raises(ValueError, match="converge"):
        fit.minimized(rosenbrock, [-1.2, 1.0], -5, 5, steps=3)


def test_scaler_and_bad_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 100.0, 5.0)], "day int, x double, still double")
    s = fit.Scaler.of(df, ["x", "still"], 1.2)
    got = s.transformed(df).orderBy("day").collect()
    assert s.scales["still"] == 1.0 and got[2]["x"] == 1.2 and got[0]["still"] == 0.0
    with pytest.raises(ValueError, match="rows"):
        fit.Scaler.of(df.where("false"), ["x"], 1.0)
    bad = spark.createDataFrame([(1, 0.0, 1.0, 0.5)], "day int, rate double, target double, a double")
    with pytest.raises(Exception, match="positive"):
        fit.Objective(bad, ["a"], 3.0).gain([0.1])
    with pytest.raises(ValueError, match="target"):
        fit.Objective(bad.withColumns({"rate": F.lit(1.0), "target": F.lit(None).cast("double")}), ["a"], 3.0)(np.array([0.1]))


@pytest.mark.parametrize("seed", [None, 5])
def test_sobol_stratifies(spark, seed):
    points = np.array([list(r)[1:] for r in designs.sobol(spark, 16, 8, seed).orderBy("id").collect()])
    assert (points == designs.sobol_points(16, 8, seed)).all() and points.min() >= 0 and points.max() < 1
    for axis in range(16):
        for m in range(1, 9):  # of the first 2^m points, one in every interval of length 2^-m
            assert sorted(np.floor(points[: 1 << m, axis] * (1 << m)).astype(int)) == list(range(1 << m))
    cells = np.floor(points[:, :2] * 16).astype(int)  # the first two axes fill every elementary box
    assert len({tuple(c) for c in cells}) == 256
    if seed is None:
        assert points[:4, 0].tolist() == [0.0, 0.5, 0.75, 0.25] and points[:4, 1].tolist() == [0.0, 0.5, 0.25, 0.75]
    else:
        assert (points != designs.sobol_points(16, 8, 6)).any()


def test_candidates(spark):
    got = designs.candidates(spark, {"a": (1.0, 100.0), "b": (-1.0, 1.0), "c": (0.1, 10.0)}, ["log", "linear", "log10"], 5, 3, control=(1.0, 0.0, 1.0)).orderBy("candidate").toPandas()
    assert list(got["candidate"]) == list(range(33)) and got.iloc[0].tolist() == [0.0, 1.0, 0.0, 1.0]
    assert got["a"].between(1, 100).all() and 14 <= (got["a"][1:] < 10).sum() <= 18 and got["b"].between(-1, 1).all()
    with pytest.raises(ValueError, match="scale"):
        designs.candidates(spark, {"a": (0.0, 1.0)}, ["log"])
    with pytest.raises(ValueError, match="axes"):
        designs.sobol(spark, 17, 3)
