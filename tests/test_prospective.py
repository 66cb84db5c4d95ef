"""Day-ahead work: carried states against whole replays, conservation, and every contract that is broken on purpose."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_replay import CLOCK, FRAILTY, TAIL, inputs
from tremorloom.functions import kernels, special
from tremorloom.operators import prospective, replay

P = kernels.Parameters(1e-2, 2e-3, 1.1, 0.01, 0.1, 100.0, 0.2, 0.8, 0.6)


def test_carried_state_is_the_replays(spark):
    t, _ = inputs(spark, 60)
    whole = replay.states(t["expected"], t["events"], t["placed"], 0, 60, CLOCK, TAIL, FRAILTY.half_life).cache()
    stored = whole.where("day = 25").select("branch", "section", "age", "exposure", "roots")
    got = prospective.carried(prospective.valid_state(stored, t["expected"]), t["expected"], t["events"].where("day >= 25"), t["placed"], 25, 60, CLOCK, TAIL, FRAILTY.half_life)
    want = {(r["branch"], r["section"]): r for r in whole.where("day = 60").collect()}
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["branch"], r["section"]]
        assert all(abs(r[c] - w[c]) < 1e-12 for c in ("age", "exposure", "roots"))
    one = prospective.carried(stored, t["expected"], t["events"].where("day = 25"), t["placed"], 25, 26, CLOCK, TAIL, FRAILTY.half_life)
    step = replay.advanced(stored, t["expected"], t["events"].where("day = 25"), t["placed"], CLOCK, TAIL, FRAILTY.half_life)
    assert sorted((r["branch"], r["section"], round(r["age"], 12), round(r["roots"], 12)) for r in one.collect()) == sorted((r["branch"], r["section"], round(r["age"], 12), round(r["roots"], 12)) for r in step.collect())
    for bad, message in ((stored.limit(3), "sections"), (stored.unionByName(stored.limit(1)), "sections"), (stored.withColumn("roots", F.lit(-1.0)), "range"), (stored.withColumn("age", F.lit(float("nan"))), "range")):
        with pytest.raises(Exception, match=message):
            prospective.valid_state(bad, t["expected"]).collect()


def test_artefacts_and_scores(spark):
    t, _ = inputs(spark, 40)
    state = replay.states(t["expected"], t["events"], t["placed"], 0, 30, CLOCK, TAIL, FRAILTY.half_life).where("day = 30")
    ahead = prospective.background_forecast(state, t["graph"], t["geometry"], t["cells"], 30, CLOCK, FRAILTY, branches=2).cache()
    base = t["cells"].select("cell", (F.col("mass") * 3).alias("rate"))
    rows = prospective.artefacts(base, ahead).collect()
    assert sum(r["baseline"] for r in rows) == pytest.approx(sum(r["challenger"] for r in rows)) and any(r["log_ratio"] != 0 for r in rows)
    for r in rows:
        assert r["log_ratio"] == pytest.approx(math.log(r["challenger"] / r["baseline"]))
    with pytest.raises(Exception, match="no rate"):
        prospective.artefacts(base.where("cell < 5"), ahead).collect()
    with pytest.raises(Exception, match="totals"):
        prospective.artefacts(base, ahead.withColumn("mixed", F.col("mixed") * 2)).collect()
    events = t["events"].where("day = 30").select("event_id", "cell", "rate")
    full = replay.evaluated(**t, first=0, end=40, clock=CLOCK, tail=TAIL, frailty=FRAILTY, branches=2)[0].where("day = 30")
    got = {r["event_id"]: r["challenger"] for r in prospective.scored_events(events, ahead).collect()}
    assert got and got == pytest.approx({r["event_id"]: r["challenger"] for r in full.collect()})


def test_shared_events_know_the_history(spark):
    rng = np.random.default_rng(3)
    cat = spark.createDataFrame(pd.DataFrame({"event_id": range(80), "us": rng.integers(0, 10 * 86_400_000_000, 80), "lon": rng.random(80), "lat": rng.random(80), "mag": rng.random(80)})).withColumns({"day": F.floor(F.col("us") / 86_400_000_000).cast("int"), "cell": F.lit(0)})
    whole = {r["event_id"]: r for r in prospective.shared_events(cat, P, 0.0, 0).collect()}
    late = prospective.shared_events(cat, P, 0.0, 6).collect()
    assert late and len(late) == cat.where("day >= 6").count()
    for r in late:
        assert r["rate"] == pytest.approx(whole[r["event_id"]]["rate"]) and r["share"] == pytest.approx(P.mu / r["rate"]) and 0 < r["share"] <= 1


def test_masses_slices_and_small_rules(spark):
    t, raw = inputs(spark, 30)
    rows = prospective.root_mass(t["events"], t["placed"]).collect()
    whole = {}
    for e in raw[3]:
        whole[e[1]] = whole.get(e[1], 0) + e[5]
    sums = {}
    for r in rows:
        sums[r["day"], r["branch"]] = sums.get((r["day"], r["branch"]), 0) + r["mass"]
    assert sums.keys() == {(d, b) for d in whole for b in (0, 1)} and all(sums[d, b] == pytest.approx(whole[d]) for d, b in sums)
    with pytest.raises(Exception, match="more than the share"):
        prospective.root_mass(t["events"], t["placed"].withColumn("p", F.lit(0.9))).collect()
    events = spark.createDataFrame([(1, 5), (2, 9), (2, 20), (3, 10)], "id int, at int")
    assert sorted(r["id"] for r in prospective.slice_of(events, "id", "at", F.lit(5), F.lit(10)).collect()) == [1, 2]
    with pytest.raises(Exception, match="repeated id 2"):
        prospective.slice_of(events, "id", "at", F.lit(5), F.lit(30)).collect()
    at = lambda *a: F.lit(dt.datetime(2024, 3, *a)).cast("timestamp")
    got = spark.range(1).select(prospective.publication_deadline(at(1, 7, 30), 15).alias("d"), prospective.forecast_window(at(2)).alias("w")).first()
    assert got["d"] == dt.datetime(2024, 3, 1, 0, 15) and (got["w"]["start"], got["w"]["end"]) == (dt.datetime(2024, 3, 2), dt.datetime(2024, 3, 3))
    with pytest.raises(Exception, match="midnight"):
        spark.range(1).select(prospective.forecast_window(at(2, 1))).collect()
    assert prospective.invalidation_threshold(365, 0.05) == 19 and prospective.invalidation_threshold(100, 0.05) == 6
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    paths = [(1, "a", "x"), (1, "b", "y"), (2, "a", "z")]
    with pytest.raises(Exception, match="run 2"):
        prospective.both_artefacts(spark.createDataFrame(paths, "run int, name string, path string"), runs, ("a", "b")).collect()
    assert [tuple(r) for r in prospective.both_artefacts(spark.createDataFrame(paths, "run int, name string, path string"), runs.where("run = 1"), ("a", "b")).collect()] == [(1, "x", "y")]
    direct = spark.range(1).select(prospective.expected_direct(F.lit(2.0), 0.0, P).alias("n")).first()["n"]
    assert direct == pytest.approx(2e-3 * math.exp(2.2) * math.pi / 0.6 * (0.2 * math.exp(1.6)) ** -0.6 * float(special.temporal_integral(np.zeros(1), np.array([1e12]), P)[0]))


def test_transfer_and_particles(spark):
    states = spark.createDataFrame([("old", 0, 1, 3, 1.0), ("old", 0, 1, 5, 2.0), ("old", 0, 1, 9, 3.0), ("old", 0, 2, 5, 4.0), ("new", 0, 2, 5, 9.0)], "protocol string, branch int, section int, as_of int, age double")
    assert [tuple(r) for r in prospective.transferred(states, "old", "new", F.lit(6)).collect()] == [("new", 0, 1, 5, 2.0)]
    geometry = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.2), (1, 1, 0.4)], "point int, section int, p double")
    particles = spark.createDataFrame([(0, 1, 1.0), (0, 2, -1.0), (1, 1, 0.0), (1, 2, 0.0)], "particle int, section int, margin double")
    cells = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "cell int, mass double")
    events = spark.createDataFrame([(7, 0), (8, 2)], "event_id int, cell int")
    got = {(r["particle"], r["event_id"]): r["adjusted"] for r in prospective.particle_backgrounds(geometry, particles, cells, events, 2.0).collect()}
    raw = np.array([1.0, 2.0, 3.0]) * np.exp(2 * np.array([0.3, 0.4, 0.0]))
    assert got[0, 7] == pytest.approx(raw[0] * 6 / raw.sum()) and got[0, 8] == pytest.approx(raw[2] * 6 / raw.sum()) and got[1, 7] == pytest.approx(1.0)
