"""Queries over published tables, resumed work, forecast text, late data and paired strata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorloom.operators import features as feats
from tremorloom.operators import late, resume, scoring
from tremorloom.plans import point_process as pp
from tremorloom.plans.registry import query
from tremorloom.session import checkpoint_folder, table
from tremorloom.sources import forecasts, published

FIRST, END = pp.FIRST, pp.LAST + 1


def _place(spark) -> str:
    return f"{checkpoint_folder(spark)}/published-{uuid.uuid4().hex}"


def _published(spark, sf_dir) -> tuple[str, str]:
    """Counts and rates of every cell-day as two published tables."""
    t = feats.trailing(feats.spine(pp.cat(spark, sf_dir), pp.grid(spark)), (30,))
    a, b = _place(spark), _place(spark)
    published.publish(t.select("cell", "day", "n"), a)
    published.publish(t.select("cell", "day", ((F.col("n_30") + 1) / 31).alias("rate")), b)
    return a, b


@query("published_join", pp.CAT + pp._TRAIL + "SELECT day, cell, n, round((n_30 + 1) / 31.0::DOUBLE, 8) AS rate FROM tr")
def published_join(spark, sf_dir):
    """Two published tables, read by their manifests and joined one to one."""
    a, b = _published(spark, sf_dir)
    return published.joined(spark, a, b, ["day", "cell"], FIRST, END).select("day", "cell", "n", pp.r("rate").alias("rate"))


@query("published_manifest", pp.CAT + "SELECT strftime(DATE '1970-01-01' + day, '%Y-%m') AS month, min(day) AS first_day, max(day) AS last_day, count(*) AS rows, count(DISTINCT day) AS days FROM cat GROUP BY ALL")
def published_manifest(spark, sf_dir):
    return published.publish(pp.cat(spark, sf_dir).drop("ts"), _place(spark)).drop("content")


_BOX = f"lon BETWEEN {min(p[0] for p in pp.POLYGON)} AND {max(p[0] for p in pp.POLYGON)} AND lat BETWEEN {min(p[1] for p in pp.POLYGON)} AND {max(p[1] for p in pp.POLYGON)}"


@query(
    "export_counts",
    pp.CAT + f""", f AS (SELECT CASE WHEN mag IS NULL THEN 'm' WHEN NOT ({_BOX}) THEN 'b' WHEN NOT ({pp._polygon_sql()}) THEN 'p' ELSE 'i' END AS why FROM cat)
    SELECT count(*) AS read, count(*) FILTER (why = 'm') AS without_magnitude, count(*) FILTER (why = 'b') AS outside_box, count(*) FILTER (why = 'p') AS outside_polygon, count(*) FILTER (why = 'i') AS included FROM f""",
)
def export_counts(spark, sf_dir):
    """A catalogue exported within a polygon: what was read, left out for which reason, and published."""
    return published.export_catalogue(pp.cat(spark, sf_dir).drop("ts"), pp.POLYGON, _place(spark))[1]


@query("resumed_days", pp.CAT + "SELECT CAST((day - 19723) // 10 AS VARCHAR) AS chunk, day, count(*) AS n, round(avg(mag), 8) AS mean, count(DISTINCT cell) AS cells FROM cat GROUP BY ALL")
def resumed_days(spark, sf_dir):
    """Daily summaries in chunks of ten days, the second half in a second attempt that finds the first half done."""
    c = pp.cat(spark, sf_dir)

    def compute(chunk: str) -> DataFrame:
        begin = FIRST + 10 * int(chunk)
        days = c.where((F.col("day") >= begin) & (F.col("day") < begin + 10))
        return days.groupBy("day").agg(F.count("*").alias("n"), F.avg("mag").alias("mean"), F.count_distinct("cell").alias("cells"))

    folder, span = _place(spark), c.agg(F.max("day")).first()[0]
    chunks = [str(i) for i in range((span - FIRST) // 10 + 1)] if span is not None else ["0"]
    resume.resumed(spark, folder, "days-1", chunks[:1], compute)
    return resume.resumed(spark, folder, "days-1", chunks, compute).select("chunk", "day", "n", pp.r("mean").alias("mean"), "cells")


@query(
    "forecast_text",
    pp.CAT + f"""SELECT m.catalog, count(event_id) AS n, round(coalesce(sum(floor(mag / 0.1 + 0.5) * 0.1), 0), 6) AS total, round(coalesce(max(lon), 0), 8) AS east FROM (SELECT DISTINCT user_id AS catalog FROM cat) m
    LEFT JOIN (SELECT * FROM cat WHERE day = {FIRST + 3} AND floor(mag / 0.1::DOUBLE + 0.5::DOUBLE) * 0.1::DOUBLE > 0.95) c ON c.user_id = m.catalog GROUP BY ALL""",
)
def forecast_text(spark, sf_dir):
    """A day's events as a forecast of a catalogue a user, most of them empty, written as text and read back."""
    c, folder = pp.cat(spark, sf_dir), _place(spark)
    members = c.select(F.col("user_id").alias("catalog")).distinct()
    t = (F.col("us") - (FIRST + 3) * 86_400_000_000) / 86_400_000_000
    events = c.where(F.col("day") == FIRST + 3).select(F.col("user_id").alias("catalog"), t.alias("t"), F.col("lon").alias("x"), F.col("lat").alias("y"), "mag")
    forecasts.write_forecast(events, members, folder, "2024-01-04 00:00:00")
    got, listed = forecasts.read_forecast(spark, folder, "2024-01-04 00:00:00", 1.0, 1.0)
    sums = got.groupBy("catalog").agg(F.count("*").alias("n"), F.sum("mag").alias("total"), F.max("x").alias("east"))
    return listed.join(sums, "catalog", "left").select("catalog", F.coalesce("n", F.lit(0)).alias("n"), pp.r(F.coalesce("total", F.lit(0.0)), 6).alias("total"), pp.r(F.coalesce("east", F.lit(0.0))).alias("east"))


_REGIONS = "['click', 'error', 'purchase', 'signup', 'view']"


@query(
    "backfilled_counts",
    pp.CAT + f""", snap AS (SELECT c_custkey AS snapshot, {_REGIONS}[c_custkey % 5 + 1] AS region, {FIRST} + c_custkey % 20 AS lo, {FIRST} + c_custkey % 20 + c_custkey % 9 AS hi FROM customer)
    , missed AS (SELECT r.region, d.day FROM (SELECT DISTINCT region FROM cat) r CROSS JOIN days d WHERE (d.day + length(r.region)) % 3 = 0)
    , first_ AS (SELECT m.region, m.day, arg_min(snapshot, (hi, snapshot)) AS snapshot FROM missed m JOIN snap s ON s.region = m.region AND lo <= m.day AND hi >= m.day + 1 GROUP BY ALL)
    SELECT f.region, f.day, f.snapshot, count(c.event_id) AS n FROM first_ f LEFT JOIN cat c ON c.region = f.region AND c.day = f.day AND c.event_id % 3 <> f.snapshot % 3 GROUP BY ALL""",
)
def backfilled_counts(spark, sf_dir):
    """Events of missed region-days, counted in the first snapshot that covers the day; a snapshot lacks a third of the events."""
    c, key = pp.cat(spark, sf_dir), F.col("c_custkey")
    regions = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    begin = FIRST + key % 20
    snapshots = table(spark, sf_dir, "customer").select(key.alias("snapshot"), regions[(key % 5).cast("int")].alias("region"), begin.alias("from"), (begin + key % 9).alias("until"))
    span = c.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    missed = c.select("region").distinct().join(F.broadcast(span)).select("region", F.explode(F.sequence("a", "b")).alias("start")).where((F.col("start") + F.length("region")) % 3 == 0).withColumn("end", F.col("start") + 1)
    windows = late.earliest_covering(missed, snapshots, ["region"], ["until"])
    events = c.select("region", F.col("day").alias("at"), "event_id")
    found = late.counted(windows, events, ["region"], 1, F.col("event_id") % 3 != F.col("snapshot") % 3)
    return found.select("region", F.col("start").alias("day"), "snapshot", "n")


@query(
    "updated_versions",
    "SELECT c_custkey, r_name AS c_mktsegment, 2 AS version FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal < 2000 UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer WHERE NOT c_acctbal < 2000",
)
def updated_versions(spark, sf_dir):
    """The newest versions after an update from a join: poor customers' segments become their regions."""
    customer = table(spark, sf_dir, "customer")
    log = customer.select("c_custkey", "c_mktsegment", F.lit(1).alias("version"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    changes = customer.where("c_acctbal < 2000").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("c_mktsegment"))
    return late.latest(log.unionByName(late.versions(log, changes, ["c_custkey"])), ["c_custkey"])


@query("json_updates", "SELECT event_id, CAST(json_merge_patch(json_object('affected', user_id), props) AS VARCHAR) AS props FROM events")
def json_updates(spark, sf_dir):
    """Every event's properties with one member set."""
    return table(spark, sf_dir, "events").select("event_id", late.json_set(F.col("props"), "affected", F.col("user_id")).alias("props"))


_GAINS = """, f AS (SELECT day, cell, n, (n_30 + 1) / 31.0::DOUBLE AS rate, (n_7 + 1) / 8.0::DOUBLE AS quick FROM tr), u AS (SELECT *, sum(rate) OVER (PARTITION BY day) / count(*) OVER (PARTITION BY day) AS uniform, sum(quick) OVER (PARTITION BY day) / count(*) OVER (PARTITION BY day) AS other FROM f)
, g AS (SELECT c.event_id, c.region, c.mag >= 2 AS strong, c.day, round(ln(u.rate / u.uniform), 9) - round(ln(u.quick / u.other), 9) AS gain FROM cat c JOIN u USING (cell, day))"""


def paired_gains(spark, sf_dir) -> DataFrame:
    """Differences of every event's gains under a monthly and a weekly forecast."""
    from pyspark.sql import Window

    w = Window.partitionBy("day")
    t = feats.trailing(feats.spine(pp.cat(spark, sf_dir), pp.grid(spark)), (7, 30)).withColumns({"rate": (F.col("n_30") + 1.0) / 31, "quick": (F.col("n_7") + 1.0) / 8})
    gain = lambda c: F.round(F.log(F.col(c) * F.count("*").over(w) / F.sum(c).over(w)), 9)  # noqa: E731  equal rates gain exactly 0
    rated = t.select("cell", "day", gain("rate").alias("left"), gain("quick").alias("right"))
    met = pp.cat(spark, sf_dir).select("event_id", "region", (F.col("mag") >= 2).alias("strong"), "cell", "day").join(rated, ["cell", "day"])
    return scoring.paired(met.withColumn("gain", F.col("left")).drop("left", "right"), met.select("event_id", F.col("right").alias("gain")))


@query("paired_strata", pp.CAT + pp._TRAIL + _GAINS + " SELECT region, strong, count(*) AS events, round(avg(gain), 8) AS mean, round(exp(avg(gain)), 8) AS factor, round(sum(gain), 6) AS total, round(avg((gain > 0)::INT), 8) AS positive_share FROM g GROUP BY ALL")
def paired_strata(spark, sf_dir):
    s = scoring.gain_summary(paired_gains(spark, sf_dir), ["region", "strong"])
    return s.select("region", "strong", "events", pp.r("mean").alias("mean"), pp.r("factor").alias("factor"), pp.r("total", 6).alias("total"), pp.r("positive_share").alias("positive_share"))


@query("paired_days", pp.CAT + pp._TRAIL + _GAINS + " SELECT r.region, d.day, round(coalesce(sum(gain), 0), 6) + 0.0 AS gain, count(gain) AS events FROM (SELECT DISTINCT region FROM cat) r CROSS JOIN days d LEFT JOIN g ON g.region = r.region AND g.day = d.day GROUP BY ALL")
def paired_days(spark, sf_dir):
    """The differences' daily sums of every stratum over all calendar days, which blocks are drawn from."""
    c = pp.cat(spark, sf_dir)
    span = c.agg(F.min("day"), F.max("day")).first()
    d = scoring.dense_days(paired_gains(spark, sf_dir), ["region"], span=(span[0] or 0, span[1] or 0))
    return d.select("region", "day", pp.r("gain", 6).alias("gain"), "events")


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    """Intervals of the mean difference of every stratum by blocks of three, seven and fourteen days."""
    return scoring.block_bootstrap(scoring.dense_days(paired_gains(spark, sf_dir), ["region"]), ["region"], [3.0, 7.0, 14.0], 400)


STRATA = ["click", "error", "purchase"]


@query("wide_days", pp.CAT + pp._TRAIL + _GAINS + " SELECT day, " + ", ".join(f"count(gain) FILTER (region = '{x}') AS events_{x}, round(coalesce(sum(gain) FILTER (region = '{x}'), 0), 6) + 0.0 AS gain_{x}" for x in STRATA) + " FROM g GROUP BY ALL")
def wide_days(spark, sf_dir):
    """The differences' daily counts and sums of three strata side by side."""
    daily = paired_gains(spark, sf_dir).groupBy("region", "day").agg(F.count("gain").alias("events"), F.sum("gain").alias("gain"))
    wide = scoring.wide_days(daily, "region", STRATA)
    return wide.select("day", *[c for x in STRATA for c in (F.col(f"events_{x}"), pp.r(f"gain_{x}", 6).alias(f"gain_{x}"))])
