"""Manifests, resumed work, forecast text, late data and strata: the good case and each bad one."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorloom.operators import late, resume, scoring
from tremorloom.sources import forecasts, published


def days(spark, first=19723, end=19783, value=1.0):
    return spark.range(first, end).select(F.col("id").cast("int").alias("day"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("cell")).withColumn("v", F.col("cell") * value)


def test_publish_and_read(spark, tmp_path):
    place = f"{tmp_path}/a"
    listed = published.publish(days(spark), place).orderBy("month").collect()
    assert [(r["month"], r["rows"], r["days"]) for r in listed] == [("2024-01", 155, 31), ("2024-02", 145, 29)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a"]  # nothing is left beside it
    with pytest.raises(FileExistsError):
        published.publish(days(spark), place)
    got = published.read_period(spark, place, 19754, 19783)
    assert got.count() == 145 and "month" in got.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-02" in plan  # pruned
    for first, end, message in ((19760, 19783, "cuts"), (1, 5, "no shard"), (19723, 19770, "cuts")):
        with pytest.raises(ValueError, match=message):
            published.read_period(spark, place, first, end)
    assert {r["content"] for r in listed} == {r["content"] for r in published.publish(days(spark).repartition(7), f"{tmp_path}/b").collect()}
    days(spark, 19754, 19755, 2.0).withColumn("month", F.lit("2024-02")).write.mode("append").partitionBy("month").parquet(f"{place}/shards")
    with pytest.raises(ValueError, match="differ"):
        published.read_period(spark, place, 19754, 19783)
    assert published.read_period(spark, place, 19754, 19783, verify=False).count() == 150


def test_strict_join(spark, tmp_path):
    place = lambda n, rows: (published.publish(rows, f"{tmp_path}/{n}"), f"{tmp_path}/{n}")[1]
    a = place("a", days(spark))
    rates = days(spark).withColumn("rate", F.col("v") + 1)
    got = published.joined(spark, a, place("b", rates.select("day", "cell", "rate")), ["day", "cell"], 19723, 19783)
    assert got.count() == 300 and got.where("rate <> v + 1").count() == 0
    cases = {"one manifest": days(spark, 19723, 19754), "periods differ": days(spark, 19724, 19783), "keys repeat": rates.unionByName(rates.where("cell = 1 AND day = 19730")), "different keys": rates.withColumn("cell", F.when(F.col("cell") == 4, 9).otherwise(F.col("cell")))}
    for message, rows in cases.items():
        with pytest.raises(ValueError, match=message):
            published.joined(spark, a, place(message.replace(" ", "-"), rows), ["day", "cell"], 19723, 19783)


def test_export_counts_each_reason_once(spark, tmp_path):
    square = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    rows = spark.createDataFrame([(19723, 1.0, 1.0, 2.0), (19724, 9.0, 9.0, 2.0), (19725, 50.0, 50.0, None), (19726, 50.0, 1.0, 1.0), (19727, None, 1.0, 1.0), (19727, 0.0, 5.0, 1.0)], "day int, lon double, lat double, mag double")
    listed, counts = published.export_catalogue(rows, square, f"{tmp_path}/c")
    assert counts.first().asDict() == {"read": 6, "without_magnitude": 1, "outside_box": 2, "outside_polygon": 1, "included": 2}
    assert listed.agg(F.sum("rows")).first()[0] == 2


def test_killed_and_resumed(spark, tmp_path):
    folder, ran = f"{tmp_path}/r", []

    def compute(chunk, fail=None):
        ran.append(chunk)
        rows = spark.range(5).select((F.col("id") * int(chunk)).alias("v"))
        return rows.withColumn("v", F.when(F.col("v") == fail, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("v"))) if chunk == "2" and fail is not None else rows

    with pytest.raises(Exception, match="killed"):
        resume.resumed(spark, folder, "s", ["0", "1", "2", "3"], lambda c: compute(c, 8))
    assert resume.finished(spark, folder) == {"0", "1"}  # the half-written chunk is not there
    got = resume.resumed(spark, folder, "s", ["0", "1", "2", "3"], compute)
    assert ran == ["0", "1", "2", "2", "3"] and sorted((r["chunk"], r["v"]) for r in got.collect()) == sorted((str(c), i * c) for c in range(4) for i in range(5))
    resume.resumed(spark, folder, "s", ["0", "1", "2", "3"], compute)
    assert len(ran) == 5
    with pytest.raises(ValueError, match="belongs"):
        resume.resumed(spark, folder, "other", ["0"], compute)
    with pytest.raises(ValueError, match="plain"):
        resume.resumed(spark, folder, "s", ["0", "0"], compute)


def test_forecast_text(spark, tmp_path):
    events = spark.createDataFrame([(1, 0.5, 1.5, 2.5, 3.04), (1, 0.25, 1.0, 2.0, 2.96), (4, 0.999, -0.1, 0.0, 5.0)], "catalog long, t double, x double, y double, mag double")
    folder = f"{tmp_path}/f"
    forecasts.write_forecast(events, spark.range(6).withColumnRenamed("id", "catalog"), folder, "2024-03-01 00:00:00")
    lines = sorted(r["value"] for r in spark.read.text(folder).collect() if not r["value"].startswith("lon"))
    assert len(lines) == 7 and sum(x.count(",") == 6 and x.startswith(",") for x in lines) == 4
    assert any(",3.0,2024-03-01T06:00:00.000,,1,1-0" in x for x in lines)
    got, members = forecasts.read_forecast(spark, folder, "2024-03-01 00:00:00", 1.0, 3.0)
    assert sorted(r["catalog"] for r in members.collect()) == list(range(6))
    assert sorted((r["catalog"], round(r["t"], 3), r["mag"]) for r in got.collect()) == [(1, 0.25, 3.0), (1, 0.5, 3.0), (4, 0.999, 5.0)]
    assert forecasts.read_forecast(spark, folder, "2024-03-01 00:00:00", 0.3, 3.0)[0].count() == 1
    assert "GreaterThanOrEqual(magnitude,3.0)" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="unknown catalogue"):
        forecasts.write_forecast(events, spark.range(2).withColumnRenamed("id", "catalog"), f"{tmp_path}/g", "2024-03-01 00:00:00")
    (tmp_path / "h").mkdir()
    (tmp_path / "h/x.csv").write_text("lon,lat,magnitude,time_string,depth,catalog_id,event_id\n1.0,,3.0,2024-03-01T06:00:00.000,,1,1-0\n")
    with pytest.raises(Exception, match="half an event"):
        forecasts.read_forecast(spark, f"{tmp_path}/h", "2024-03-01 00:00:00", 1.0, 3.0)[1].collect()


def test_late_counts_against_brute_force(spark):
    rng = np.random.default_rng(4)
    w = [("k" if i % 2 else None, int(a), int(a + n), i) for i, (a, n) in enumerate(zip(rng.integers(0, 300, 40), rng.integers(0, 90, 40), strict=True))] + [("k", 5, 70, 1), ("k", 5, 70, 1)]
    e = [("k" if i % 3 else "other", int(t)) for i, t in enumerate(rng.integers(0, 400, 500))]
    got = late.counted(spark.createDataFrame(w, "key string, start long, end long, id int"), spark.createDataFrame(e, "key string, at long"), ["key"], 16).collect()
    assert len(got) == len(set(w))
    for r in got:
        assert r["n"] == sum(k == r["key"] and r["start"] <= t < r["end"] for k, t in e)
    windows = spark.createDataFrame([("a", 3, 4), ("a", 9, 10), ("b", 3, 4)], "region string, start int, end int")
    snaps = spark.createDataFrame([("a", 7, 0, 4), ("a", 5, 0, 4), ("a", 4, 0, 8), ("a", 1, 4, 9), ("b", 2, 4, 9)], "region string, snapshot int, from int, until int")
    assert [tuple(r) for r in late.earliest_covering(windows, snaps, ["region"], ["until"]).collect()] == [("a", 3, 4, 5)]


def test_versions_and_json(spark):
    log = spark.createDataFrame([(1, "x", 1.0, 1), (1, "y", 1.0, 2), (2, "z", 2.0, 1), (3, None, 3.0, 1)], "id int, name string, v double, version int")
    changes = spark.createDataFrame([(1, "n"), (2, "z"), (3, "m"), (9, "q")], "id int, name string")
    assert sorted(tuple(r) for r in late.versions(log, changes, ["id"]).collect()) == [(1, "n", 1.0, 3), (3, "m", 3.0, 2)]
    assert late.versions(late.latest(log, ["id"]), changes.where("false"), ["id"]).count() == 0
    with pytest.raises(Exception, match="several changes"):
        late.versions(log, changes.unionByName(changes), ["id"]).collect()
    rows = spark.createDataFrame([('{"b": 1.5, "a": {"x": [1, 2]}, "k": "old", "n": null, "t": "q\\"u"}', "é"), (None, "1"), ("[1]", None), ("no json", "x")], "t string, v string")
    assert [r[0] for r in rows.select(late.json_set(F.col("t"), "k", F.col("v"))).collect()] == ['{"a":{"x":[1,2]},"b":1.5,"k":"é","n":null,"t":"q\\"u"}', '{"k":"1"}', '{"k":null}', '{"k":"x"}']


def test_strata(spark):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"s": ["a"] * 200 + ["b"] * 100, "day": [*range(200), *range(50, 150)], "gain": rng.normal(1, 1, 300), "events": rng.poisson(3, 300)})
    df = spark.createDataFrame(d)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = scoring.block_bootstrap(df, ["s"], [5.0, 20.0], 250).orderBy("s", "block").collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    two = scoring.block_bootstrap(df.repartition(3), ["s"], [5.0, 20.0], 250).orderBy("s", "block").collect()
    assert one == two and len(one) == 4 and all(r["replicates"] == r["valid"] == 250 and r["lower"] < r["median"] < r["upper"] for r in one)
    for r in one:
        part = d[d["s"] == r["s"]]
        assert r["lower"] < part["gain"].sum() / part["events"].sum() < r["upper"]
    with pytest.raises(Exception, match="without events"):
        scoring.block_bootstrap(df.withColumn("events", F.when(F.col("day") == 60, 1).otherwise(0)), ["s"], [30.0], 100).collect()
    gains = spark.createDataFrame([(1, "x", 10, 0.5), (2, "x", 13, -0.25), (3, "y", 11, 0.0)], "event_id int, s string, day int, gain double")
    dense = scoring.dense_days(gains, ["s"]).orderBy("s", "day").collect()
    assert [(r["day"], r["gain"], r["events"]) for r in dense] == [(10, 0.5, 1), (11, 0.0, 0), (12, 0.0, 0), (13, -0.25, 1), (11, 0.0, 1)]
    s = {r["s"]: r for r in scoring.gain_summary(gains, ["s"]).collect()}
    assert s["x"]["mean"] == 0.125 and s["x"]["factor"] == pytest.approx(math.exp(0.125)) and s["x"]["positive_share"] == 0.5 and s["y"]["positive_share"] == 0
    other = spark.createDataFrame([(1, 0.25), (2, 0.25), (3, -1.0)], "event_id int, gain double")
    assert {r["event_id"]: r["gain"] for r in scoring.paired(gains, other).collect()} == {1: 0.25, 2: -0.5, 3: 1.0}
    for bad in (other.where("event_id < 3"), other.unionByName(other.limit(1))):
        with pytest.raises(Exception, match="not one pair"):
            scoring.paired(gains, bad).collect()
