"""Readers, regions, masks and causal bounds: golden records, edges of every interval, and what is left out."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorloom.functions import geo, kernels, special
from tremorloom.operators import catalog, causal, forecast, grid, oplog
from tremorloom.sources import readers

GOLDEN = "J198301010036584  02  33467  09  139212  11  21  39 39V   111F  3104NEAR MIYAKEJIMA ISLAND     K"


def record(**fields):
    """The golden record with other characters at given places."""
    line = list(GOLDEN)
    for at, text in fields.values():
        line[at : at + len(text)] = text
    return "".join(line)


def test_fixed_width(spark, tmp_path):
    lines = [
        GOLDEN,
        record(type=(0, "X")),
        record(magnitude=(52, "  ")),
        record(depth=(44, "     ")),
        record(depth=(44, " 10.5"), magnitude=(52, "-3")),
        record(second=(13, "60  ")),
        record(second=(13, "5999")),
        record(second=(13, "7.25")),
        record(date=(5, "0231")),
        record(minute=(24, "6   "), lon=(32, "-139")),
        GOLDEN[:57],
        record(lat=(21, " x3")),
    ]
    (tmp_path / "r.txt").write_text("\n".join(lines) + "\n")
    got = readers.fixed_width(spark, f"{tmp_path}/r.txt").collect()
    assert len(got) == 5
    first = got[0]
    assert first["magnitude"] == 3.9
    utc = [r[0] for r in readers.fixed_width(spark, f"{tmp_path}/r.txt").select(F.date_format("origin_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")).collect()]
    assert utc[0] == "1982-12-31 15:36:58.400000"
    assert first["latitude"] == 33 + 46.7 / 60 and first["longitude"] == 139 + 21.2 / 60 and first["depth"] == 21 and (first["magtype"], first["agency"]) == ("V", "J")
    assert (got[1]["depth"], got[1]["magnitude"]) == (10.5, -0.3)
    assert utc[2].endswith("59.990000") and utc[3].endswith("07.250000")
    assert got[4]["latitude"] == 33 + 6 / 60 and got[4]["longitude"] == -139 + 21.2 / 60


def test_named_regions(spark):
    rows = spark.createDataFrame([(1, 142.0, 40.0, 10.0, 4.5), (2, 141.0, 36.0, 100.0, 4.5), (3, 145.0, 40.0, 10.0, 4.5), (4, 142.0, 40.0, 100.1, 6.0), (5, 142.0, 46.9, 1.0, 5.0), (6, 142.0, 40.0, 1.0, 3.0)], "id int, longitude double, latitude double, depth double, magnitude double")
    ids = lambda name, features=False: sorted(r["id"] for r in readers.in_named_region(rows, name, features).collect())
    assert ids("A") == [1, 2] and ids("B") == [] and ids("C") == [5] and ids("C", True) == [1, 2, 3, 5, 6]


def test_catalogue_csv_grid_json_and_regions(spark, tmp_path):
    (tmp_path / "c.csv").write_text("event_id,origin_time,latitude,longitude,depth,magnitude\na,2024-01-01T23:30:00Z,1.0,2.0,5.0,3.0\na,2024-01-02T00:30:00Z,1.0,2.0,5.0,3.0\nb,2024-01-03T00:00:00Z,10.0,2.0,5.0,3.0\nc,2024-01-03T00:00:00Z,1.0,2.0,40.0,3.0\nd,2024-01-02T00:00:00Z,1.0,2.0,5.0,1.0\n")
    utc, east = (readers.catalogue_csv(spark, f"{tmp_path}/c.csv", z).orderBy("event_id", "origin_time").collect() for z in ("UTC", "+01:00"))
    assert utc[0]["day"] == 19723 and east[0]["day"] == 19724
    box = (0.0, 0.0, 10.0, 10.0)
    kept = readers.in_region(readers.catalogue_csv(spark, f"{tmp_path}/c.csv"), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03").cast("timestamp"), box, 2.0, (0.0, 40.0))
    assert [(r["event_id"], r["day"]) for r in kept.collect()] == [("a", 19723)]
    (tmp_path / "g.json").write_text(json.dumps({"origin_units": [[0, 0], [1, 0], [5, 2]]}))
    cells = readers.grid_json(spark, f"{tmp_path}/g.json")
    assert [tuple(r) for r in cells.orderBy("cell").collect()] == [(0, 0, 0), (1, 1, 0), (2, 5, 2)]
    assert tuple(grid.bounds(cells, 0.5).first()) == (0.0, 3.0, 0.0, 1.5)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.49, 0.49), (3, 0.5, 0.5), (4, 2.5, 1.2), (5, 1.0, 0.0), (6, -0.01, 0.0)], "id int, lon double, lat double")
    assert sorted(r["id"] for r in grid.in_cells(points, cells, 0.5).collect()) == [1, 2, 4]


def test_windows_transition_destination_and_ratio(spark):
    years = spark.range(1).select(F.explode(catalog.year_windows(F.lit("2019-06-01").cast("timestamp"), F.lit("2021-01-01").cast("timestamp"))).alias("y")).select("y.*").collect()
    assert [(r["start"].year, r["end"].year) for r in years] == [(2019, 2020), (2020, 2021)] and years[0]["start"].month == 6
    cells = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 5, 5)], "cell int, x int, y int")
    assert sorted(tuple(r) for r in grid.transition(cells).collect()) == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)]
    lat, lon = geo.destination(F.lit(0.0), F.lit(179.5), F.lit(6378.1 * math.radians(1.0)), F.lit(math.pi / 2))
    got = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert abs(got["lat"]) < 1e-12 and got["lon"] == pytest.approx(-179.5)
    p = kernels.Parameters(1e-3, 2e-3, 1.1, 0.01, 0.1, 100.0, 0.2, 0.8, 0.6)
    t = np.geomspace(1e-9, 1e4, 400_001)
    f = np.exp(-t / p.tau) * (t + p.c) ** -1.1
    time = np.trapezoid(f, t)
    assert special.branching_ratio(2.3, p) == pytest.approx(p.k0 * time * math.pi / p.rho * p.d**-p.rho * 2.3 / (2.3 - 0.62), rel=1e-4)
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 15)), (2, dt.datetime(2024, 1, 1, 0, 15, 1)), (3, dt.datetime(2023, 12, 31, 23, 59))], "id int, at timestamp")
    assert [r["id"] for r in oplog.on_time(rows, "at", F.lit(dt.datetime(2024, 1, 1)), 15).collect()] == [1]


def test_kernel_columns_agree_with_their_sums(spark):
    """The column expressions, multiplied out over all pairs, give what the causal join sums on arrays."""
    p = kernels.Parameters(1e-3, 2e-3, 1.1, 0.01, 0.1, 100.0, 0.2, 0.8, 0.6)
    rng = np.random.default_rng(1)
    cat = spark.createDataFrame(pd.DataFrame({"event_id": range(60), "us": rng.integers(0, 5 * 86_400_000_000, 60), "lon": rng.random(60), "lat": rng.random(60), "mag": rng.random(60) * 2})).withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("int"))
    t, s = cat.alias("t"), cat.alias("s")
    days = (F.col("t.us") - F.col("s.us")) / 86_400_000_000
    r2 = F.pow(F.col("t.lon") - F.col("s.lon"), 2) + F.pow(F.col("t.lat") - F.col("s.lat"), 2)
    rate = kernels.triggering_rate(F.col("s.mag"), days, r2, 0.0, p)
    product = kernels.productivity(F.col("s.mag"), 0.0, p) * kernels.temporal_kernel(days, p) * kernels.spatial_kernel(r2, F.col("s.mag"), 0.0, p)
    want = {r["event_id"]: (r["a"], r["b"]) for r in t.join(s, F.col("s.us") < F.col("t.us")).groupBy("t.event_id").agg(F.sum(rate).alias("a"), F.sum(product).alias("b")).collect()}
    for r in causal.prior_intensity(cat, p, 0.0).collect():
        a, b = want.get(r["event_id"], (0.0, 0.0))
        assert r["triggered"] == pytest.approx(a, rel=1e-9) == pytest.approx(b, rel=1e-9)


def test_tolerance_bounds_what_is_left_out(spark):
    p = kernels.Parameters(1e-3, 2e-3, 1.1, 0.01, 0.1, 3.0, 0.2, 0.8, 0.6)
    rng = np.random.default_rng(2)
    n = 1500
    cat = spark.createDataFrame(pd.DataFrame({"event_id": range(n), "us": np.sort(rng.integers(0, 800 * 86_400_000_000, n)), "lon": rng.random(n) * 9, "lat": rng.random(n) * 9, "mag": rng.random(n) * 2})).withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("int")).cache()
    horizon = causal.kernel_horizon(causal.source_mass(cat, p, 0.0), p, 1e-6)
    assert 5 < horizon < 100
    whole = {r["event_id"]: r for r in causal.prior_sums(cat, p, 0.0, plane=True).collect()}
    near = {r["event_id"]: r for r in causal.prior_sums(cat, p, 0.0, plane=True, tolerance=1e-6).collect()}
    assert whole.keys() == near.keys()
    for k, w in whole.items():
        assert near[k]["n_prior"] == w["n_prior"]
        for c in ("triggered", "frozen", "temporal"):
            assert -1e-12 <= w[c] - near[k][c] <= 1e-6
    left, right = causal.block_pairs(cat.withColumns({"o": F.col("us"), "block": F.floor(F.col("day") / 5).cast("int")}), 0, 159, -(-horizon // 5))
    assert right.count() < n * (horizon // 5 + 3)  # linear in the events, not 160 blocks for each
    with pytest.raises(ValueError, match="tolerance"):
        causal.kernel_horizon(1.0, p, 0.0)


def test_composed_and_checked(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.5, 1.0), (1, 1.0, 0.5, -1.0), (1, 0.2, 0.3, 0.0)], "k int, total double, background double, margin double")
    got = forecast.composed(rows, ["k"], "total", "background", "margin", 0.7).collect()
    tilt = [0.5 * math.exp(0.7), 0.5 * math.exp(-0.7), 0.3]
    assert [r["composed"] for r in got] == pytest.approx([t + a * 1.3 / sum(tilt) for t, a in zip((1.5, 0.5, 0.0), tilt, strict=True)])
    with pytest.raises(Exception, match="totals of total and margin"):
        forecast.checked_total(rows, ["k"], "total", "margin").collect()
