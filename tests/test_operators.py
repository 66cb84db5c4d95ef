"""Formulas against quadrature and brute force; leakage, conservation and replay properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorloom.functions import geo, identity, kernels, special
from tremorloom.operators import catalog, causal, features, forecast, grid, oplog, particles, scoring, simulate, state
from tremorloom.plans import simulation
from tremorloom.plans.point_process import DAYS, M0, P, cat
from tremorloom.sources import readers, sinks
from tremorloom.streaming import daily

DATA = "/root/testdata/sf0.001"


def integrate(f, a, b, n=400_001):
    x = np.linspace(a, b, n)
    y = f(x)
    h = (b - a) / (n - 1)
    return h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


@pytest.mark.parametrize("omega", [-0.06, 0.0, 0.1])
def test_temporal_integral_by_quadrature(omega):
    p = kernels.Parameters(1e-5, 2e-3, 1.1, 0.01, omega, 100.0, 0.2, 0.8, 0.6)
    f = lambda u: np.exp(-(np.exp(u) - p.c) / p.tau) * np.exp(u) ** -(1 + omega) * np.exp(u)  # noqa: E731  in log(t + c)
    want = integrate(f, math.log(p.c), math.log(30 + p.c))
    assert special.temporal_integral(np.array([0.0]), np.array([30.0]), p)[0] == pytest.approx(want, rel=1e-9)


def test_incomplete_gamma_inverts():
    q = np.array([0.01, 0.3, 0.7, 0.999])
    for s in (0.06, 0.5, 3.0):
        assert special.lower_gamma(s, special.inverse_lower_gamma(s, q)) == pytest.approx(q, rel=1e-8)


def test_overdue_by_quadrature():
    shape = 4.0
    f = lambda x: np.sqrt(shape / (2 * np.pi * x**3)) * np.exp(-shape * (x - 1) ** 2 / (2 * x))
    for age in (0.5, 1.0, 2.0):
        want = max(0.0, math.log(f(np.array([age]))[0] / integrate(f, age, 60)))
        assert special.overdue(np.array([age]), 0.5)[0] == pytest.approx(want, abs=1e-6)
    assert special.overdue(np.array([0.0]), 0.5)[0] == 0


def test_expected_reset_weight_by_quadrature():
    beta, m0, full, b = 2.3, 2.5, 6.0, 0.75
    f = lambda m: beta * np.exp(-beta * (m - m0)) * np.minimum(1, 10 ** (b * (m - full)))
    assert kernels.expected_reset_weight(beta, m0, full, b) == pytest.approx(integrate(f, m0, 40), rel=1e-6)


def test_right_closed_edges(spark):
    edges = [float(k) for k in range(0, 20)]
    xs = edges + [math.nextafter(x, math.inf) for x in edges] + [math.nextafter(x, -math.inf) for x in edges] + [-3.0, math.nextafter(-3.0, math.inf), -0.5, 7.25]
    got = [r["c"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(geo.right_closed(F.col("x")).alias("c")).collect()]
    assert got == [math.ceil(math.nextafter(x, -math.inf)) - 1 for x in xs]


def test_polygon_boundary(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    got = spark.createDataFrame([(0.5, 0.5), (1.0, 1.0), (1.5, 1.5)], "x double, y double").select(geo.in_polygon(F.col("x"), F.col("y"), square).alias("i")).collect()
    assert [r["i"] for r in got] == [True, True, False]


def test_email_and_locale(spark):
    r = spark.createDataFrame([(" A@B.org ", "JA-jp"), ("nope", None)], "e string, l string").select(identity.email(F.col("e")).alias("e"), identity.locale(F.col("l")).alias("l")).collect()
    assert [tuple(x) for x in r] == [("a@b.org", "ja"), (None, "en")]


def test_causal_sums_see_only_earlier_events(spark):
    c = cat(spark, DATA)
    whole = {r["event_id"]: r for r in causal.prior_intensity(c, P, M0).collect()}
    rows = c.toPandas()
    cut = int(rows["day"].median())
    early = {r["event_id"]: r for r in causal.prior_intensity(c.where(F.col("day") < cut), P, M0, block_days=3).collect()}
    for k, r in early.items():
        assert r["n_prior"] == whole[k]["n_prior"] and r["triggered"] == pytest.approx(whole[k]["triggered"], rel=1e-12)


def test_later_days_change_no_feature(spark):
    c, g = cat(spark, DATA), grid.cells(spark)
    a = features.trailing(features.spine(c, g)).where("day <= 19740").orderBy("cell", "day").toPandas()
    later = c.where("day <= 19740").unionByName(c.where("day > 19740").withColumn("cell", (F.col("cell") * 7 + 3) % 100))
    b = features.trailing(features.spine(later, g)).where("day <= 19740").orderBy("cell", "day").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_states_equal_a_loop(spark):
    d = features.spine(cat(spark, DATA), grid.cells(spark)).where("cell < 5")
    e = d.withColumn("o", F.col("n") * 0.3)
    age = state.hazard_age(e, ["cell"], "day", 0.05, "o").orderBy("cell", "day").toPandas()
    s = state.cusum(e, ["cell"], "day", F.col("n"), F.lit(0.4), 0.9).orderBy("cell", "day").toPandas()
    m = state.decayed_sum(e, ["cell"], "day", F.col("n").cast("double"), 5.0, "m").orderBy("cell", "day").toPandas()
    raw = d.orderBy("cell", "day").toPandas()
    for _, at in raw.groupby("cell").indices.items():
        a = v = q = 0.0
        for i in at:
            assert age["state"][i] == pytest.approx(a) and s["state"][i] == pytest.approx(v) and m["m"][i] == pytest.approx(q)
            n = raw["n"][i]
            a, v, q = (a + 0.05) * math.exp(-0.3 * n), max(0.0, v * 0.9 + n - 0.4), q * 0.5**0.2 + n


def test_mass_is_conserved(spark):
    b = features.background(cat(spark, DATA), grid.cells(spark), DAYS, 10.0).withColumns({"k": F.lit(1), "s": F.sin("cell")})
    for f in (forecast.softmax_tilt(b, ["k"], "rate", "s", 2.0, "out"), forecast.bounded_mixture(b, ["k"], "rate", "s", 0.4, 2.0, out="out")):
        r = f.agg(F.sum("rate"), F.sum("out")).first()
        assert r[0] == pytest.approx(r[1], rel=1e-12)
    same = forecast.bounded_mixture(b, ["k"], "rate", "s", 0.0, 2.0, out="out").where("out <> rate")
    assert same.count() == 0


def test_particles_take_every_region_and_cell(spark):
    got = simulation.particle_assimilation(spark, DATA).groupBy("region").agg(F.count_distinct("section").alias("s"), F.count_distinct("particle").alias("p"), F.count_distinct("day").alias("d")).collect()
    assert {tuple(r) for r in got} == {(r["region"], 100, 8, r["d"]) for r in cat(spark, DATA).groupBy("region").agg(F.count_distinct("day").alias("d")).collect()}


def test_particles_equal_a_loop(spark):
    """Every particle on its own, with masks, events of several sections, and rows that count for nothing."""
    rng = np.random.default_rng(4)
    margins = rng.normal(size=(3, 6))
    active = rng.random((3, 6)) < 0.7
    active[:, 0] = True
    events = [("r", d, o, 10 * d + o, float(rng.uniform(0, 3)), float(rng.random()), int(k), float(rng.uniform(0, 0.5))) for d in range(4) for o in range(3) for k in rng.choice(6, 2, replace=False)]
    events += [("r", 2, 9, 99, None, 0.5, 1, 0.5), ("r", 5, 0, 98, 1.0, 0.5, None, 0.5), ("other", 1, 0, 97, 1.0, 0.5, 1, 0.5)]
    load = np.linspace(-0.1, 0.2, 6)
    states = spark.createDataFrame([("r", p, s, float(margins[p, s]), bool(active[p, s])) for p in range(3) for s in range(6)], "region string, particle long, section int, margin double, active boolean")
    table = spark.createDataFrame(events, "region string, day int, order int, event_id long, magnitude double, probability double, section int, weight double").repartition(3)
    for masked in (True, False):
        got = {(r["particle"], r["day"], r["section"]): r["margin"] for r in particles.assimilate_regions(states if masked else states.drop("active"), table, load, 0.3, 0.05, 0.5, 1.0).collect()}
        assert {d for _, d, _ in got} == {0, 1, 2, 3, 5} and len(got) == 3 * 5 * 6
        for p in range(3):
            m, on = margins[p].copy(), active[p] if masked else np.ones(6, bool)
            for d in (0, 1, 2, 3, 5):
                m = m + load * on
                for key in sorted({e[2:4] for e in events if e[0] == "r" and e[1] == d and e[4] is not None and e[6] is not None}):
                    before = m.copy()
                    for e in events:
                        if e[0] == "r" and e[1] == d and e[2:4] == key and on[e[6]]:
                            m[e[6]] += 0.3 * e[5] * e[7] / (1 + np.exp(before[e[6]])) - 0.05 * 10 ** (0.5 * (e[4] - 1.0)) * e[7]
                m = np.where(on, m - m[on].mean(), m)
                assert [got[p, d, s] for s in range(6)] == pytest.approx(m.tolist(), abs=1e-12)


def test_coupling_is_whole_without_a_reach(spark):
    sections = spark.createDataFrame([(i, float(i % 5), float(i // 5), float(7 * i % 180), "ab"[i % 2]) for i in range(20)], "section int, sx double, sy double, strike double, model string")
    whole = particles.coupling(sections, 1.0, 0.3)
    assert whole.count() == 2 * 10 * 9 and particles.coupling(sections, 1.0, 0.3, 1.5).count() < 180
    assert whole.where("weight <= 0").count() == 0


def test_a_busy_block_is_dealt_into_parts(spark, monkeypatch):
    c = cat(spark, DATA)
    whole = {r["event_id"]: r for r in causal.prior_intensity(c, P, M0).collect()}
    monkeypatch.setattr(causal, "BLOCK_ROWS", 40)
    rows = c.select("event_id", "us", F.col("us").alias("o"), "lat", "lon", "mag", F.lit(0).alias("block"))
    for side in causal.block_pairs(rows, 0, 0, 0):
        assert side.groupBy("a", "ap", "b", "bp").count().agg(F.max("count")).first()[0] <= 80
    for r in causal.prior_intensity(c, P, M0).collect():
        assert r["n_prior"] == whole[r["event_id"]]["n_prior"] and r["triggered"] == pytest.approx(whole[r["event_id"]]["triggered"], rel=1e-9, abs=1e-15)


def test_log_operators(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    assert [r["k"] for r in oplog.insert_absent(new, stored, ["k"]).collect()] == [3]
    assert oplog.conflicts(new, stored, ["k"], ["v"]).count() == 0
    assert oplog.conflicts(new.withColumn("v", F.lit("z")), stored, ["k"], ["v"]).count() == 1


def test_event_text_source(spark, tmp_path):
    (tmp_path / "e.txt").write_text("#EventID|Time|Latitude|Longitude|Depth/km|Magnitude|MagType\nb|2020-01-02T00:00:00|1|2|3|4.5|ml\na|2020-01-01T00:00:00Z|1|2||4.0|ml\nc|bad|1|2|3|4|ml\n")
    got = readers.event_text(spark, str(tmp_path / "e.txt")).orderBy("origin_time").collect()
    assert [(r["event_id"], r["event_type"]) for r in got] == [("a", "earthquake"), ("b", "earthquake")]


def test_identity_ignores_order(spark):
    c = cat(spark, DATA)
    a, b = (sinks.content_sha256(x, ["event_id", "day", "cell"]).first()[0] for x in (c, c.orderBy(F.desc("event_id"))))
    assert a == b and a != sinks.content_sha256(c.where("event_id > 0"), ["event_id", "day", "cell"]).first()[0]


def test_month_shards_resume(spark, tmp_path):
    c = cat(spark, DATA)
    sinks.write_months(c.select("day", "event_id"), str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == c.count()
    assert [r["month"] for r in sinks.missing_months(spark.createDataFrame([("2024-01",), ("2024-02",)], "month string"), back.withColumn("month", F.col("month").cast("string"))).collect()] == ["2024-02"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = daily.daily_counts(daily.event_stream(spark, str(tmp_path / "in"), rows.schema), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily_counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("daily_counts").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in rows.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_carried_state_equals_decayed_sum(spark, tmp_path):
    days = spark.createDataFrame([("a", d, float(d % 3)) for d in range(6)] + [("b", d, 1.0) for d in range(6)], "key string, day int, n double")
    days.coalesce(1).write.parquet(str(tmp_path / "days"))
    stream = daily.carried_state(spark.readStream.schema(days.schema).parquet(str(tmp_path / "days")), 5.0)
    q = stream.writeStream.outputMode("append").format("memory").queryName("carried").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["key"], r["day"]): r["state"] for r in spark.table("carried").collect()}
    want = state.decayed_sum(days, ["key"], "day", F.col("n"), 5.0, "s").collect()
    assert len(got) == 12
    for r in want:
        assert got[r["key"], r["day"]] == pytest.approx(r["s"])


def test_decayed_sum_of_a_long_series(spark):
    """Eight thousand days at a half-life of three: more than 2,600 half-lives, with a long silence."""
    n = [float(i % 7 == 0) * (1 + i % 5) if not 2000 < i < 5500 else 0.0 for i in range(8000)]
    days = spark.createDataFrame([("a", 100 + i, v) for i, v in enumerate(n)], "key string, day int, n double")
    got = [r["s"] for r in state.decayed_sum(days, ["key"], "day", F.col("n"), 3.0, "s").orderBy("day").collect()]
    want, r = 0.0, 0.5 ** (1 / 3)
    for have, v in zip(got, n, strict=True):
        assert have == pytest.approx(want, rel=1e-9, abs=1e-60)
        want = want * r + v


@pytest.mark.parametrize("many", [1, 3, 400])
def test_nearest_sections_equal_all_pairs(spark, many):
    """Clustered, equal and far sections, fewer than k too."""
    rng = np.random.default_rng(many)
    sections = [(i, *map(float, rng.normal(0, 1 if i % 3 else 40, 2).round(1))) for i in range(many)]
    points = [(i, *map(float, rng.uniform(-60, 60, 2))) for i in range(30)]
    got = grid.nearest(spark.createDataFrame(points, "point int, px double, py double"), spark.createDataFrame(sections, "section int, sx double, sy double"), 4)
    have = {(r["point"], r["rank"]): r["section"] for r in got.collect()}
    want = {}
    for i, x, y in points:
        near = sorted((math.sqrt((x - sx) ** 2 + (y - sy) ** 2), j) for j, sx, sy in sections)[:4]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(near)}
    assert have == want


def test_daily_scores_by_brute_force(spark):
    c = cat(spark, DATA).select("event_id", "day", "us", "lat", "lon", "mag").cache()
    events = c.toPandas()
    got = causal.daily_scores(c, 19730, 19733, P, M0, 100.0, 0.02).toPandas().set_index("day")
    day_us = 86_400_000_000
    for day in (19730, 19731, 19732):
        start, end = day * day_us, (day + 1) * day_us
        mass = P.k0 * np.exp(P.a * events.mag) * math.pi / P.rho * (P.d * np.exp(P.gamma * events.mag)) ** -P.rho
        old, new = events.us < start, (events.us >= start) & (events.us < end)
        history = (mass[old] * special.temporal_integral((start - events.us[old]) / day_us, (end - events.us[old]) / day_us, P)).sum()
        inside = (mass[new] * special.temporal_integral(np.zeros(new.sum()), (end - events.us[new]) / day_us, P)).sum()
        frozen = sequential = 0.0
        for t in events[new].itertuples():
            h = events[events.us < t.us]
            dt, r2 = (t.us - h.us) / day_us, (t.lon - h.lon) ** 2 + (t.lat - h.lat) ** 2
            rate = P.k0 * np.exp(P.a * h.mag) * np.exp(-dt / P.tau) * (dt + P.c) ** -(1 + P.omega) * (r2 + P.d * np.exp(P.gamma * h.mag)) ** -(1 + P.rho)
            frozen += math.log(P.mu + rate[h.us < start].sum())
            sequential += math.log(P.mu + rate.sum())
        row = got.loc[day]
        assert row.history_events == old.sum() and row.target_events == new.sum()
        assert row.frozen_ll == pytest.approx(frozen - P.mu * 100 - history, rel=1e-9)
        assert row.sequential_ll == pytest.approx(sequential - P.mu * 100 - history - inside, rel=1e-9)
        assert row.poisson_ll == pytest.approx(new.sum() * math.log(0.02) - 2.0)


def test_causal_sums_of_edge_cases(spark):
    day_us = 86_400_000_000
    rows = [(1, 0, 0, 0.0, 0.0, 1.0), (2, 0, 5, 0.0, 0.0, None), (3, 0, 5, 0.0, 0.0, 1.0), (4, 900, 900 * day_us, 0.0, 0.0, 2.0)]
    c = spark.createDataFrame(rows, "event_id long, day int, us long, lon double, lat double, mag double")
    short = kernels.Parameters(1e-3, 2e-3, 1.1, 0.01, 0.1, 1e-3, 0.2, 0.8, 0.6)
    got = {r.event_id: r for r in causal.prior_sums(c, short, 0.0).collect()}
    assert [got[i].n_prior for i in (1, 2, 3, 4)] == [0, 1, 1, 3]  # equal times do not trigger each other
    assert got[1].triggered == 0 and got[2].triggered == got[3].triggered > 0
    assert got[4].triggered == 0  # a taper far past the range of a double
    assert causal.prior_sums(c.limit(0), short, 0.0).count() == 0
    since = causal.incremental_intensity(c, 900, short, 0.0).collect()
    assert [(r.event_id, r.n_prior) for r in since] == [(4, 3)]


def test_lookups_with_contracts(spark):
    events = spark.createDataFrame([(1, 0), (2, 1)], "event_id long, cell int")
    rates = spark.createDataFrame([(0, 2.0)], "cell int, rate double")
    assert forecast.rate_of(events.where("cell = 0"), rates, ["cell"]).collect()[0].rate == 2.0
    with pytest.raises(Exception, match="no rate for"):
        forecast.rate_of(events, rates, ["cell"]).collect()
    scores = spark.createDataFrame([("x", 1, 5.0, True), ("x", 2, 5.0, True), ("x", 3, 9.0, False), ("y", 4, 1.0, False)], "k string, id int, score double, ok boolean")
    best = {r.k: r.best for r in forecast.best_candidate(scores, ["k"], "id", "score", F.col("ok")).collect()}
    assert best == {"x": 1, "y": 0}


def test_periods_and_prefixes(spark):
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "day int")
    assert catalog.joined_periods(days(1, 2), days(3)).count() == 3
    assert catalog.joined_periods(days(1, 2).limit(0), days(3)).count() == 1
    with pytest.raises(ValueError, match="starts on day 4"):
        catalog.joined_periods(days(1, 2), days(4))
    assert tuple(catalog.prefix_differences(days(1, 1, 2), days(1, 2, 2, 5), 5).first()) == (1, 1)
    assert tuple(catalog.prefix_differences(days(1), days(1, 6), 5).first()) == (0, 0)
