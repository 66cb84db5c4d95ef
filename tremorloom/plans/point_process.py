"""Point-process queries over the fixture tables: events as a marked catalogue on a 10 by 10 grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorloom.functions import geo, identity, kernels
from tremorloom.operators import causal, forecast, oplog, particles, scoring, state
from tremorloom.operators import catalog as catalogs
from tremorloom.operators import features as feats
from tremorloom.operators import grid as grids
from tremorloom.plans.registry import query
from tremorloom.session import table

#: Triggering parameters of the queries, with the reference magnitude and area.
P = kernels.Parameters(mu=1e-3, k0=2e-3, a=1.1, c=0.01, omega=0.1, tau=100.0, d=0.2, gamma=0.8, rho=0.6)
M0, DAYS, FIRST, LAST = 0.0, 30, 19723, 19752
#: What causal sums may lack at most; it sets how far back they look.
TOLERANCE = 1e-10
BETA = 2.1471442086213064

CAT = """
WITH cat0 AS (
  SELECT event_id, ts, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, epoch_us(ts) AS us, user_id, event_type AS region, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS cell FROM events
), cat AS (
  SELECT *, cell % 10 AS x, cell // 10 AS y, cell % 10 + (user_id % 10) / 10.0::DOUBLE AS lon, cell // 10 + (event_id % 10) / 10.0::DOUBLE AS lat,
         floor(log10(value + 1) / 0.1::DOUBLE + 0.5::DOUBLE) * 0.1::DOUBLE AS mag FROM cat0
), grid AS (
  SELECT CAST(i AS INTEGER) AS cell, CAST(i % 10 AS INTEGER) AS x, CAST(i // 10 AS INTEGER) AS y FROM range(100) t(i)
), edges AS (
  SELECT a.cell, b.cell AS neighbour FROM grid a JOIN grid b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.cell <> b.cell
), days AS (
  SELECT CAST(d AS INTEGER) AS day FROM (SELECT unnest(range(min(day), max(day) + 1)) AS d FROM cat)
), dense AS (
  SELECT g.cell, d.day, count(c.event_id) AS n FROM grid g CROSS JOIN days d LEFT JOIN cat c ON c.cell = g.cell AND c.day = d.day GROUP BY ALL
)
"""


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.catalogue(table(spark, sf_dir, "events"))


def grid(spark: SparkSession) -> DataFrame:
    return grids.cells(spark)


def r(c: Column | str, n: int = 8) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


@query("catalog_clean", CAT + "SELECT event_id, day, cell, round(lon, 8) AS lon, round(lat, 8) AS lat, round(mag, 8) AS mag FROM cat WHERE day >= 19727 AND day < 19747 AND mag >= 1.0")
def catalog_clean(spark, sf_dir):
    kept = catalogs.selected(cat(spark, sf_dir), FIRST + 4, FIRST + 24, 1.0)
    return kept.select("event_id", "day", "cell", r("lon").alias("lon"), r("lat").alias("lat"), r("mag").alias("mag"))


@query("catalog_counts", CAT + "SELECT count(*) AS rows, count(*) FILTER (day >= 19727 AND day < 19747) AS in_period, count(*) FILTER (mag >= 1.5) AS above, count(*) FILTER (day >= 19727 AND day < 19747 AND mag >= 1.5) AS selected, count(*) FILTER (mag IS NULL) AS without_magnitude FROM cat")
def catalog_counts(spark, sf_dir):
    return catalogs.source_counts(cat(spark, sf_dir), 1.5, FIRST + 4, FIRST + 24)


POLYGON = [(1.0, 1.0), (8.0, 1.5), (9.0, 7.0), (4.0, 9.0), (1.0, 1.0)]


def _polygon_sql() -> str:
    crossings = []
    for (ax, ay), (bx, by) in zip(POLYGON, POLYGON[1:], strict=False):
        crossings.append(f"(({ay}::DOUBLE > lat) <> ({by}::DOUBLE > lat) AND lon < {bx - ax}::DOUBLE * (lat - {ay}) / {by - ay}::DOUBLE + {ax})::INT")
    edges = " OR ".join(f"(abs((lon - {ax}) * {by - ay}::DOUBLE - (lat - {ay}) * {bx - ax}::DOUBLE) <= 1e-12 AND lon BETWEEN {min(ax, bx)} - 1e-12 AND {max(ax, bx)} + 1e-12 AND lat BETWEEN {min(ay, by)} - 1e-12 AND {max(ay, by)} + 1e-12)" for (ax, ay), (bx, by) in zip(POLYGON, POLYGON[1:], strict=False))
    return f"({' + '.join(crossings)}) % 2 = 1 OR {edges}"


@query("bbox_polygon", CAT + f"SELECT event_id, {_polygon_sql()} AS inside FROM cat WHERE lon >= 1 AND lon <= 9 AND lat >= 1 AND lat <= 9")
def bbox_polygon(spark, sf_dir):
    c = cat(spark, sf_dir).where("lon >= 1 AND lon <= 9 AND lat >= 1 AND lat <= 9")
    return c.select("event_id", geo.in_polygon(F.col("lon"), F.col("lat"), POLYGON).alias("inside"))


@query(
    "cell_assign_right_closed",
    CAT + """SELECT event_id, CASE WHEN i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 9 THEN CAST(j * 10 + i AS INTEGER) ELSE -1 END AS assigned FROM (
      SELECT event_id, CAST(ceil(nextafter(lon, -1e308::DOUBLE)) - 1 AS BIGINT) AS i, CAST(ceil(nextafter(lat, -1e308::DOUBLE)) - 1 AS BIGINT) AS j FROM cat)""",
)
def cell_assign_right_closed(spark, sf_dir):
    return cat(spark, sf_dir).select("event_id", grids.cell_right_closed(F.col("lon"), F.col("lat")).alias("assigned"))


@query("cell_assign_clipped", CAT + "SELECT event_id, CAST(least(greatest(floor(lat * 1.3 - 2), 0), 9) * 10 + least(greatest(floor(lon * 1.3 - 2), 0), 9) AS INTEGER) AS assigned FROM cat")
def cell_assign_clipped(spark, sf_dir):
    return cat(spark, sf_dir).select("event_id", grids.cell_clipped(F.col("lon") * 1.3 - 2, F.col("lat") * 1.3 - 2).alias("assigned"))


def known_cells(spark, sf_dir) -> DataFrame:
    """The cells that the catalogue has events in."""
    return cat(spark, sf_dir).select("cell", "x", "y").distinct()


_AREA = "6371.0088 * 6371.0088 * radians(1.0) * (sin(radians(y + 1.0)) - sin(radians(y + 0.0)))"


@query("cell_area", CAT + f"SELECT DISTINCT cell, round({_AREA}, 4) AS area FROM cat")
def cell_area(spark, sf_dir):
    return known_cells(spark, sf_dir).select("cell", r(geo.cell_area_km2(F.col("y").cast("double"), 1.0), 4).alias("area"))


@query(
    "latent_grid",
    CAT + f""", known AS (SELECT DISTINCT cell, x, y FROM cat) SELECT g.cell, CAST(l.latent AS INTEGER) AS latent, round(l.area, 4) AS area FROM known g JOIN (
      SELECT lx, ly, dense_rank() OVER (ORDER BY ly, lx) - 1 AS latent, area FROM (SELECT x // 3 AS lx, y // 3 AS ly, sum({_AREA}) AS area FROM known GROUP BY ALL)) l ON g.x // 3 = l.lx AND g.y // 3 = l.ly""",
)
def latent_grid(spark, sf_dir):
    return grids.latent(known_cells(spark, sf_dir), 3).select("cell", F.col("latent").cast("int").alias("latent"), r("area", 4).alias("area"))


@query("neighbor_sum", CAT + "SELECT e.cell, CAST(sum(v.n) AS BIGINT) AS neighbour_n FROM edges e JOIN (SELECT g.cell, count(c.event_id) AS n FROM grid g LEFT JOIN cat c USING (cell) GROUP BY ALL) v ON v.cell = e.neighbour GROUP BY ALL")
def neighbor_sum(spark, sf_dir):
    n = grid(spark).select("cell").join(cat(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").fillna(0)
    return grids.neighbour_values(n, grid(spark), "n", [])


@query("neighbor_min", CAT + "SELECT e.cell, CASE WHEN count(*) < 8 THEN least(min(v.n), 5) ELSE min(v.n) END AS neighbour_n FROM edges e JOIN (SELECT g.cell, count(c.event_id) AS n FROM grid g LEFT JOIN cat c USING (cell) GROUP BY ALL) v ON v.cell = e.neighbour GROUP BY ALL")
def neighbor_min(spark, sf_dir):
    n = grid(spark).select("cell").join(cat(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").fillna(0)
    return grids.neighbour_values(n, grid(spark), "n", [], "min", 5).select("cell", long("neighbour_n").alias("neighbour_n"))


_SECTIONS = "SELECT s_suppkey AS section, (s_suppkey * 37 % 100) / 10.0::DOUBLE AS sx, (s_suppkey * 61 % 100) / 10.0::DOUBLE AS sy FROM supplier"


def sections(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("section"), ((F.col("s_suppkey") * 37 % 100) / 10.0).alias("sx"), ((F.col("s_suppkey") * 61 % 100) / 10.0).alias("sy"))


def points(spark):
    return grid(spark).select(F.col("cell").alias("point"), (F.col("x") + 0.5).alias("px"), (F.col("y") + 0.5).alias("py"))


_KNN = CAT + f""", sec AS ({_SECTIONS}), near AS (
  SELECT * FROM (SELECT g.cell AS point, s.section, sqrt((g.x + 0.5 - sx) ** 2 + (g.y + 0.5 - sy) ** 2) AS distance,
    row_number() OVER (PARTITION BY g.cell ORDER BY sqrt((g.x + 0.5 - sx) ** 2 + (g.y + 0.5 - sy) ** 2), section) AS rank FROM grid g CROSS JOIN sec s) WHERE rank <= 4
), geom AS (
  SELECT point, section, w / (1 + sum(w) OVER (PARTITION BY point)) AS p, 1 / (1 + sum(w) OVER (PARTITION BY point)) AS off
  FROM (SELECT *, CASE WHEN distance <= 1.2 THEN 2.0::DOUBLE * exp(-0.5::DOUBLE * (distance / 0.7::DOUBLE) ** 2) ELSE 0 END AS w FROM near)
)
"""


@query("knn_sections", _KNN + "SELECT point, section, round(distance, 8) AS distance, CAST(rank AS INTEGER) AS rank FROM near")
def knn_sections(spark, sf_dir):
    return grids.nearest(points(spark), sections(spark, sf_dir), 4).select("point", "section", r("distance").alias("distance"), "rank")


def geometry(spark, sf_dir):
    return grids.sparse_geometry(grids.nearest(points(spark), sections(spark, sf_dir), 4), 0.7, 1.2, 2.0)


@query("sparse_geometry", _KNN + "SELECT point, section, round(p, 8) AS p, round(off, 8) AS off FROM geom")
def sparse_geometry(spark, sf_dir):
    return geometry(spark, sf_dir).select("point", "section", r("p").alias("p"), r("off").alias("off"))


@query("section_mass", _KNN + "SELECT section, round(sum(p * n), 6) AS mass FROM geom JOIN (SELECT cell AS point, count(*) AS n FROM cat GROUP BY ALL) USING (point) GROUP BY ALL")
def section_mass(spark, sf_dir):
    mass = cat(spark, sf_dir).groupBy(F.col("cell").alias("point")).agg(F.count("*").alias("mass"))
    return grids.section_mass(geometry(spark, sf_dir), mass).select("section", r("mass", 6).alias("mass"))


@query(
    "neighbor_transition_topk",
    CAT + """, w AS (SELECT e.cell AS src, e.neighbour AS dst, count(c.event_id) AS weight FROM edges e LEFT JOIN cat c ON c.cell = e.neighbour GROUP BY ALL),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM w WHERE weight > 0) WHERE k <= 3)
    SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 8) AS weight FROM t UNION ALL SELECT cell, cell, 1.0 FROM grid WHERE cell NOT IN (SELECT src FROM t)""",
)
def neighbor_transition_topk(spark, sf_dir):
    n = cat(spark, sf_dir).groupBy(F.col("cell").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    e = grids.edges(grid(spark)).select(F.col("cell").alias("src"), F.col("neighbour").alias("dst")).join(n, "dst", "left").fillna(0.0)
    return grids.strongest(e.select("src", "dst", "weight"), 3).select("src", "dst", r("weight").alias("weight"))


@query("axial_mean", CAT + "SELECT region, round(((degrees(atan2(s, c)) / 2) % 180 + 180) % 180, 6) AS strike FROM (SELECT region, sum(sqrt(dx * dx + dy * dy) * cos(2 * atan2(dy, dx))) AS c, sum(sqrt(dx * dx + dy * dy) * sin(2 * atan2(dy, dx))) AS s FROM (SELECT region, lon - 5 AS dx, lat - 4 AS dy FROM cat) GROUP BY ALL)")
def axial_mean(spark, sf_dir):
    s = cat(spark, sf_dir).select("region", (F.col("lon") - 5).alias("dx"), (F.col("lat") - 4).alias("dy"))
    return grids.axial_mean(s, "region").select("region", r("strike", 6).alias("strike"))


_HAV = "2 * 6378.1 * asin(sqrt(least(greatest(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2, 0), 1)))"


@query("haversine_steps", CAT + f", o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY us, event_id) AS i FROM cat) SELECT b.event_id, round({_HAV}, 5) AS km FROM o a JOIN o b ON a.region = b.region AND b.i = a.i + 1")
def haversine_steps(spark, sf_dir):
    w = Window.partitionBy("region").orderBy("us", "event_id")
    c = cat(spark, sf_dir).withColumns({"la": F.lag("lat").over(w), "lo": F.lag("lon").over(w)}).where("la IS NOT NULL")
    return c.select("event_id", r(geo.haversine_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 5).alias("km"))


def _prior_sql(order: str) -> str:
    source = f"""2e-3::DOUBLE * exp(1.1::DOUBLE * h.mag) * exp(-((t.us - h.us) / 86400000000.0::DOUBLE) / 100) * pow((t.us - h.us) / 86400000000.0::DOUBLE + 0.01::DOUBLE, -1.1::DOUBLE)
      * pow((t.lon - h.lon) ** 2 + (t.lat - h.lat) ** 2 + 0.2::DOUBLE * exp(0.8::DOUBLE * h.mag), -1.6::DOUBLE)"""
    return f", s AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS seq FROM cat) SELECT t.event_id, count(h.event_id) AS n_prior, round(coalesce(sum({source}), 0), 8) AS triggered FROM s t LEFT JOIN s h ON h.{order} < t.{order} GROUP BY ALL"


@query("prior_intensity_by_ts", CAT + _prior_sql("us"))
def prior_intensity_by_ts(spark, sf_dir):
    return causal.prior_intensity(cat(spark, sf_dir), P, M0, tolerance=TOLERANCE).select("event_id", "n_prior", r("triggered").alias("triggered"))


@query("prior_intensity_by_seq", CAT + _prior_sql("seq"))
def prior_intensity_by_seq(spark, sf_dir):
    return causal.prior_intensity(causal.sequenced(cat(spark, sf_dir)), P, M0, ties=True, tolerance=TOLERANCE).select("event_id", "n_prior", r("triggered").alias("triggered"))


@query("incremental_intensity", "SELECT * FROM (" + CAT + _prior_sql("us") + ") WHERE event_id IN (SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-26')")
def incremental_intensity(spark, sf_dir):
    return causal.incremental_intensity(cat(spark, sf_dir), FIRST + 25, P, M0, tolerance=TOLERANCE).select("event_id", "n_prior", r("triggered").alias("triggered"))


@query(
    "temporal_intensity",
    CAT
    + """SELECT t.event_id, count(h.event_id) AS n_prior, round(1e-3::DOUBLE * 100 + coalesce(sum(2e-3::DOUBLE * exp(1.1::DOUBLE * h.mag) * exp(-((t.us - h.us) / 86400000000.0::DOUBLE) / 100)
      * pow((t.us - h.us) / 86400000000.0::DOUBLE + 0.01::DOUBLE, -1.1::DOUBLE) * pi() / 0.6::DOUBLE * pow(0.2::DOUBLE * exp(0.8::DOUBLE * h.mag), -0.6::DOUBLE)), 0), 6) AS intensity
      FROM cat t LEFT JOIN cat h ON h.us < t.us GROUP BY ALL""",
)
def temporal_intensity(spark, sf_dir):
    sums = causal.prior_sums(cat(spark, sf_dir), P, M0, plane=True, tolerance=TOLERANCE, place=False)
    return sums.select("event_id", "n_prior", r(P.mu * AREA + F.col("temporal"), 6).alias("intensity"))


_TERMS = f"""nodes(x, w) AS (VALUES {",".join(f"({x!r}::DOUBLE,{w!r}::DOUBLE)" for x, w in zip(*map(lambda a: a.tolist(), np.polynomial.legendre.leggauss(20)), strict=True))})
  , tg AS (SELECT event_id, us, coalesce(lag(us) OVER (ORDER BY us, event_id), {FIRST} * 86400000000) AS since, row_number() OVER (ORDER BY us, event_id) = 1 AS first FROM cat WHERE mag >= 2.3)
  , pr AS (SELECT t.event_id, sum(k * exp(-dt / 100) * pow(dt + 0.01::DOUBLE, -1.1::DOUBLE) * pow(dx * dx + dy * dy + sc, -1.6::DOUBLE)) AS point, sum(k * exp(-dt / 100) * pow(dt + 0.01::DOUBLE, -1.1::DOUBLE) * pi() / 0.6::DOUBLE * pow(sc, -0.6::DOUBLE)) AS temporal
    FROM (SELECT t.event_id, (t.us - h.us) / 86400000000.0::DOUBLE AS dt, c.lon - h.lon AS dx, c.lat - h.lat AS dy, 2e-3::DOUBLE * exp(1.1::DOUBLE * h.mag) AS k, 0.2::DOUBLE * exp(0.8::DOUBLE * h.mag) AS sc FROM tg t JOIN cat c USING (event_id) JOIN cat h ON h.us < t.us) t GROUP BY ALL)
  , en AS (SELECT t.event_id, 2e-3::DOUBLE * exp(1.1::DOUBLE * h.mag) * pi() / 0.6::DOUBLE * pow(0.2::DOUBLE * exp(0.8::DOUBLE * h.mag), -0.6::DOUBLE) AS mass, ln(greatest(t.since - h.us, 0) / 86400000000.0::DOUBLE + 0.01::DOUBLE) AS lo, ln((t.us - h.us) / 86400000000.0::DOUBLE + 0.01::DOUBLE) AS hi FROM tg t JOIN cat h ON h.us < t.us)
  , it AS (SELECT event_id, sum(mass * (hi - lo) / 2 * w * exp(-(exp((hi - lo) / 2 * x + (hi + lo) / 2) - 0.01::DOUBLE) / 100 - 0.1::DOUBLE * ((hi - lo) / 2 * x + (hi + lo) / 2))) AS v FROM en CROSS JOIN nodes GROUP BY ALL)"""


@query(
    "target_terms",
    CAT + ", " + _TERMS + """ SELECT t.event_id, round(1e-3::DOUBLE + coalesce(point, 0), 6) AS point, round(0.1::DOUBLE + coalesce(temporal, 0), 5) AS temporal, round(0.1::DOUBLE * (us - since) / 86400000000.0::DOUBLE + coalesce(v, 0), 5) AS corrected,
    round(0.1::DOUBLE * (us - since) / 86400000000.0::DOUBLE + CASE WHEN first THEN 0 ELSE coalesce(v, 0) END, 5) AS strict FROM tg t LEFT JOIN pr USING (event_id) LEFT JOIN it USING (event_id)""",
)
def target_terms(spark, sf_dir):
    """Both intensities of every strong event and the expected number of its own interval."""
    c = cat(spark, sf_dir)
    found = causal.target_terms(c, P, M0, AREA, c.where("mag >= 2.3").select("event_id", "us", "day"), FIRST * 86_400_000_000, TOLERANCE)
    return found.select("event_id", r("point", 6).alias("point"), *[r(x, 5).alias(x) for x in ("temporal", "corrected", "strict")])


#: Area of the 10 by 10 grid in its own units, and the rate of the Poisson lane.
AREA, POISSON_MU = 100.0, 2e-2


def _masses_sql() -> str:
    """CTE masses(day, from_history, from_inside): the time integrals by Gauss-Legendre nodes in the logarithm of the delay."""
    nodes = ",".join(f"({x!r}::DOUBLE,{w!r}::DOUBLE)" for x, w in zip(*map(lambda a: a.tolist(), np.polynomial.legendre.leggauss(16)), strict=True))
    return f""", nodes(x, w) AS (VALUES {nodes}),
      ends AS (SELECT d.day, c.us < d.day * 86400000000 AS before, 2e-3::DOUBLE * exp(1.1::DOUBLE * c.mag) * pi() / 0.6::DOUBLE * pow(0.2::DOUBLE * exp(0.8::DOUBLE * c.mag), -0.6::DOUBLE) AS mass,
        ln(greatest(d.day - c.us / 86400000000.0::DOUBLE, 0) + 0.01::DOUBLE) AS lo, ln(d.day + 1 - c.us / 86400000000.0::DOUBLE + 0.01::DOUBLE) AS hi
        FROM days d JOIN cat c ON c.us < (d.day + 1) * 86400000000),
      integrals AS (SELECT day, before, mass * (hi - lo) / 2 * w * exp(-(exp((hi - lo) / 2 * x + (hi + lo) / 2) - 0.01::DOUBLE) / 100 - 0.1::DOUBLE * ((hi - lo) / 2 * x + (hi + lo) / 2)) AS v FROM ends CROSS JOIN nodes),
      masses AS (SELECT day, coalesce(sum(v) FILTER (before), 0) AS from_history, coalesce(sum(v) FILTER (NOT before), 0) AS from_inside FROM integrals GROUP BY ALL)"""


@query("interval_compensator", CAT + _masses_sql() + " SELECT day, round(1e-3::DOUBLE * 100 + coalesce(from_history, 0) + coalesce(from_inside, 0), 6) AS expected FROM days LEFT JOIN masses USING (day)")
def interval_compensator(spark, sf_dir):
    c = cat(spark, sf_dir)
    span = c.agg(F.min("day"), F.max("day")).first()
    us = 86_400_000_000
    days = spark.range(span[0] or 0, 0 if span[1] is None else span[1] + 1).select("id", (F.col("id") * us).alias("start_us"), ((F.col("id") + 1) * us).alias("end_us"))
    found = days.select("id").join(causal.compensator(c, days, P, M0), "id", "left").fillna(0)
    return found.select(F.col("id").cast("int").alias("day"), r(P.mu * AREA + F.col("from_history") + F.col("from_inside"), 6).alias("expected"))


_LANES = f"""{_masses_sql()}, point AS (SELECT t.event_id, t.day, coalesce(sum(v) FILTER (h_day < t.day), 0) AS frozen, coalesce(sum(v), 0) AS triggered FROM cat t LEFT JOIN (
    SELECT t.event_id, h.day AS h_day, 2e-3::DOUBLE * exp(1.1::DOUBLE * h.mag) * exp(-((t.us - h.us) / 86400000000.0::DOUBLE) / 100) * pow((t.us - h.us) / 86400000000.0::DOUBLE + 0.01::DOUBLE, -1.1::DOUBLE)
      * pow((t.lon - h.lon) ** 2 + (t.lat - h.lat) ** 2 + 0.2::DOUBLE * exp(0.8::DOUBLE * h.mag), -1.6::DOUBLE) AS v FROM cat t JOIN cat h ON h.us < t.us) USING (event_id) GROUP BY ALL),
  logs AS (SELECT day, count(*) AS n, sum(ln(1e-3::DOUBLE + frozen)) AS f, sum(ln(1e-3::DOUBLE + triggered)) AS s FROM point GROUP BY ALL),
  lanes AS (SELECT d.day, (SELECT count(*) FROM cat WHERE cat.day < d.day) AS history_events, coalesce(n, 0) AS target_events, 0.1::DOUBLE + coalesce(from_history, 0) AS frozen_rate, coalesce(f, 0) AS frozen_log_sum,
    0.1::DOUBLE + coalesce(from_history, 0) + coalesce(from_inside, 0) AS sequential_rate, coalesce(s, 0) AS sequential_log_sum, 2.0::DOUBLE AS poisson_rate, coalesce(n, 0) * ln({POISSON_MU}::DOUBLE) - 2.0::DOUBLE AS poisson_ll
    FROM range({FIRST}, {LAST + 1}) g(i) JOIN (SELECT CAST(i AS INTEGER) AS day FROM range({FIRST}, {LAST + 1}) q(i)) d ON d.day = g.i LEFT JOIN masses m ON m.day = d.day LEFT JOIN logs l ON l.day = d.day)"""


def _scores(spark, sf_dir):
    return causal.daily_scores(cat(spark, sf_dir), FIRST, LAST + 1, P, M0, AREA, POISSON_MU)


@query(
    "daily_lanes",
    CAT + _LANES + """ SELECT day, history_events, target_events, round(frozen_rate, 6) AS frozen_rate, round(frozen_log_sum, 6) AS frozen_log_sum, round(frozen_log_sum - frozen_rate, 6) AS frozen_ll, round(sequential_rate, 6) AS sequential_rate,
      round(sequential_log_sum, 6) AS sequential_log_sum, round(sequential_log_sum - sequential_rate, 6) AS sequential_ll, round(poisson_rate, 6) AS poisson_rate, round(poisson_ll, 6) AS poisson_ll FROM lanes""",
)
def daily_lanes(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.select("day", "history_events", "target_events", *[r(c, 6).alias(c) for c in s.columns[3:]])


@query(
    "replay_lane_summary",
    CAT + _LANES + """, l AS (SELECT 'frozen' AS lane, target_events AS n, frozen_rate AS rate, frozen_log_sum - frozen_rate AS ll FROM lanes UNION ALL SELECT 'sequential', target_events, sequential_rate, sequential_log_sum - sequential_rate FROM lanes
      UNION ALL SELECT 'poisson', target_events, poisson_rate, poisson_ll FROM lanes) SELECT lane, count(*) AS days, CAST(sum(n) AS BIGINT) AS observed, round(sum(rate), 6) AS expected, round(sum(n) / sum(rate), 6) AS ratio,
      round(sum(ll), 6) AS total_ll, round(sum(ll) / count(*), 6) AS per_day, round(sum(ll) / nullif(sum(n), 0), 6) AS per_event FROM l GROUP BY lane""",
)
def replay_lane_summary(spark, sf_dir):
    s = causal.lane_summary(_scores(spark, sf_dir))
    return s.select("lane", "days", "observed", *[r(c, 6).alias(c) for c in ("expected", "ratio", "total_ll", "per_day", "per_event")])


@query("day_cell_histogram", CAT + "SELECT day, cell, count(*) AS n, count(*) FILTER (mag >= 1.5) AS n15, count(*) FILTER (mag >= 2.0) AS n20 FROM cat GROUP BY ALL")
def day_cell_histogram(spark, sf_dir):
    return cat(spark, sf_dir).groupBy("day", "cell").agg(F.count("*").alias("n"), F.count_if(F.expr("mag >= 1.5")).alias("n15"), F.count_if(F.expr("mag >= 2.0")).alias("n20"))


_BG = ", cnt AS (SELECT g.cell, count(c.event_id) AS n FROM grid g LEFT JOIN cat c USING (cell) GROUP BY ALL), bg AS (SELECT cell, (n + (SELECT avg(n) / 30 FROM cnt) * 10) / 40.0::DOUBLE AS rate FROM cnt)"


@query("background_smoothing", CAT + _BG + "SELECT cell, round(rate, 8) AS rate FROM bg")
def background_smoothing(spark, sf_dir):
    return feats.background(cat(spark, sf_dir), grid(spark), DAYS, 10.0).select("cell", r("rate").alias("rate"))


@query("background_shares", CAT + _BG + "SELECT c.event_id, round(least(greatest(b.rate / (b.rate + 0.1::DOUBLE * (d.n - 3)), 0), 1), 8) AS share FROM cat c JOIN dense d USING (cell, day) JOIN bg b USING (cell)")
def background_shares(spark, sf_dir):
    c, own = cat(spark, sf_dir), feats.background(cat(spark, sf_dir), grid(spark), DAYS, 10.0).select("cell", "rate")
    totals = feats.spine(c, grid(spark)).join(own, "cell").select("cell", "day", (F.col("rate") + 0.1 * (F.col("n") - 3)).alias("rate"))
    return forecast.background_shares(c.select("event_id", "cell", "day"), totals, own, ["day", "cell"]).select("event_id", r("share").alias("share"))


@query("best_candidate", CAT + "SELECT region, coalesce(max_by(cell, n * 1000 - cell) FILTER (top >= 2), 0) AS best FROM (SELECT region, cell, count(*) AS n, max(mag) AS top FROM cat GROUP BY ALL) GROUP BY ALL")
def best_candidate(spark, sf_dir):
    scores = cat(spark, sf_dir).groupBy("region", "cell").agg(F.count("*").alias("n"), F.max("mag").alias("top"))
    return forecast.best_candidate(scores, ["region"], "cell", "n", F.col("top") >= 2)


@query("rate_differences", CAT + _BG + "SELECT round(max(abs(d.n - b.rate)), 8) AS largest, round(avg(abs(d.n - b.rate)), 8) AS mean FROM dense d JOIN bg b USING (cell)")
def rate_differences(spark, sf_dir):
    c = cat(spark, sf_dir)
    pairs = feats.spine(c, grid(spark)).join(feats.background(c, grid(spark), DAYS, 10.0).select("cell", "rate"), "cell")
    return forecast.rate_differences(pairs, "n", "rate").select(r("largest").alias("largest"), r("mean").alias("mean"))


@query("joined_periods", CAT + "SELECT day, count(*) AS n FROM cat GROUP BY ALL")
def joined_periods(spark, sf_dir):
    c = cat(spark, sf_dir).select("event_id", "day")
    return catalogs.joined_periods(c.where(F.col("day") < FIRST + 15), c.where(F.col("day") >= FIRST + 15)).groupBy("day").agg(F.count("*").alias("n"))


@query("prefix_differences", CAT + f"SELECT count(*) FILTER (cell = 7) AS missing, 0::BIGINT AS extra FROM cat WHERE day < {FIRST + 15}")
def prefix_differences(spark, sf_dir):
    c = cat(spark, sf_dir).select("event_id", "day", "us", "cell", "mag")
    return catalogs.prefix_differences(c.where((F.col("day") < FIRST + 15) & (F.col("cell") != 7)), c, FIRST + 15)


_TRAIL = ", tr AS (SELECT cell, day, n, " + ", ".join(f"CAST(coalesce(sum(n) OVER (PARTITION BY cell ORDER BY day RANGE BETWEEN {d} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_{d}" for d in (3, 7, 30, 90)) + ", CAST(coalesce(least(day - max(CASE WHEN n > 0 THEN day END) OVER (PARTITION BY cell ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 365), 365) AS INTEGER) AS recency FROM dense)"


@query("trailing_windows", CAT + _TRAIL + "SELECT cell, day, n, n_3, n_7, n_30, n_90 FROM tr")
def trailing_windows(spark, sf_dir):
    return feats.trailing(feats.spine(cat(spark, sf_dir), grid(spark)))


@query("recency_capped", CAT + _TRAIL + "SELECT cell, day, n, recency FROM tr")
def recency_capped(spark, sf_dir):
    return feats.recency(feats.spine(cat(spark, sf_dir), grid(spark)), 365)


_SNAP = _BG + _TRAIL + """, fl AS (SELECT avg(rate) * 0.1::DOUBLE AS floor FROM bg), loc AS (
  SELECT t.*, ln(greatest((n_7 + 7 * greatest(rate, floor)) / 14, floor) / greatest(rate, floor)) AS excess_7, ln(greatest((n_30 + 7 * greatest(rate, floor)) / 37, floor) / greatest(rate, floor)) AS excess_30,
    ln((n_7 / 7 + greatest(rate, floor)) / (n_30 / 30 + greatest(rate, floor))) AS acceleration FROM tr t JOIN bg USING (cell), fl
)"""


@query(
    "feature_snapshot",
    CAT + _SNAP + """SELECT l.cell, l.day, l.n_7, l.n_30, l.recency, round(l.excess_7, 7) + 0.0 AS excess_7, round(l.excess_30, 7) + 0.0 AS excess_30, round(l.acceleration, 7) + 0.0 AS acceleration, CAST(sum(b.n_7) AS BIGINT) AS neighbour_n_7,
      CAST(CASE WHEN count(*) < 8 THEN least(min(b.recency), 365) ELSE min(b.recency) END AS DOUBLE) AS neighbour_recency FROM loc l JOIN edges e ON e.cell = l.cell JOIN loc b ON b.cell = e.neighbour AND b.day = l.day GROUP BY ALL""",
)
def feature_snapshot(spark, sf_dir):
    s = feats.snapshot(cat(spark, sf_dir), grid(spark), DAYS)
    return s.select("cell", "day", "n_7", "n_30", "recency", *[r(c, 7).alias(c) for c in ("excess_7", "excess_30", "acceleration")], "neighbour_n_7", F.col("neighbour_recency").cast("double").alias("neighbour_recency"))


def _forecast(spark, sf_dir):
    """Per day and cell: smoothed rate from strictly earlier days, and a uniform rate of the same total."""
    t = feats.trailing(feats.spine(cat(spark, sf_dir), grid(spark)), (30,))
    w = Window.partitionBy("day")
    rated = t.withColumn("rate", (F.col("n_30") + 1.0) / 31)
    return rated.withColumn("uniform", F.sum("rate").over(w) / F.count("*").over(w))


@query(
    "igpe_daily",
    CAT + _TRAIL + """, f AS (SELECT day, cell, n, (n_30 + 1) / 31.0::DOUBLE AS rate FROM tr), u AS (SELECT *, sum(rate) OVER (PARTITION BY day) / count(*) OVER (PARTITION BY day) AS uniform FROM f)
      SELECT day, CAST(sum(n) AS BIGINT) AS events, round(sum(n * ln(rate / uniform)), 6) AS gain, round(sum(n * ln(rate / uniform)) / nullif(sum(n), 0), 8) AS igpe FROM u GROUP BY ALL""",
)
def igpe_daily(spark, sf_dir):
    f = _forecast(spark, sf_dir).withColumn("gain", F.col("n") * kernels.information_gain(F.col("rate"), F.col("uniform")))
    return f.groupBy("day").agg(F.sum("n").alias("events"), r(F.sum("gain"), 6).alias("gain"), r(scoring.igpe(F.col("gain"), F.col("n"))).alias("igpe"))


@query(
    "igpe_strata",
    CAT + _TRAIL + """, f AS (SELECT day, cell, n, (n_30 + 1) / 31.0::DOUBLE AS rate FROM tr), u AS (SELECT *, sum(rate) OVER (PARTITION BY day) / count(*) OVER (PARTITION BY day) AS uniform FROM f),
      g AS (SELECT c.region, c.day, ln(u.rate / u.uniform) AS gain FROM cat c JOIN u USING (day, cell)), d AS (SELECT region, day, sum(gain) AS gain, count(*) AS events FROM g GROUP BY ALL)
      SELECT region, CAST(sum(events) AS BIGINT) AS events, round(sum(gain), 6) AS total, round(sum(gain) / sum(events), 8) AS igpe, count(*) FILTER (gain > 0) AS ahead, count(*) FILTER (gain < 0) AS behind FROM d GROUP BY ALL""",
)
def igpe_strata(spark, sf_dir):
    f = _forecast(spark, sf_dir)
    gains = forecast.rate_pairs(cat(spark, sf_dir).select("region", "day", "cell"), f.select("day", "cell", F.col("uniform").alias("rate")), f.select("day", "cell", "rate"), ["day", "cell"])
    daily = gains.groupBy("region", "day").agg(F.sum("gain").alias("gain"), F.count("*").alias("events"))
    return scoring.summary(daily, ["region"]).select("region", "events", r("total", 6).alias("total"), r("igpe").alias("igpe"), "ahead", "behind")


@query("lane_summary", CAT + "SELECT region, count(*) AS observed, round(sum(mag), 6) AS total, round(avg(mag), 8) AS mean, round(median(mag), 8) AS median, round(avg((mag > 1.5)::INT), 8) AS share, round(quantile_cont(mag, 0.1), 8) AS q10, round(quantile_cont(mag, 0.9), 8) AS q90, round(var_pop(mag), 8) AS variance FROM cat GROUP BY ALL")
def lane_summary(spark, sf_dir):
    return cat(spark, sf_dir).groupBy("region").agg(F.count("*").alias("observed"), r(F.sum("mag"), 6).alias("total"), r(F.avg("mag")).alias("mean"), r(F.median("mag")).alias("median"), r(F.avg((F.col("mag") > 1.5).cast("int"))).alias("share"), r(F.percentile("mag", F.lit(0.1))).alias("q10"), r(F.percentile("mag", F.lit(0.9))).alias("q90"), r(F.var_pop("mag")).alias("variance"))


@query("annual_robust", CAT + "SELECT region, round(avg(m) - stddev_pop(m), 8) AS robust, round(min(m), 8) AS worst, count(*) FILTER (m > 0) AS positive_years FROM (SELECT region, day // 7 AS y, avg(mag - 2.0) AS m FROM cat GROUP BY ALL) GROUP BY ALL")
def annual_robust(spark, sf_dir):
    g = cat(spark, sf_dir).withColumn("gain", F.col("mag") - 2.0)
    return scoring.robust(g, F.floor(F.col("day") / 7), "gain", ["region"]).select("region", r("robust").alias("robust"), r("worst").alias("worst"), "positive_years")


@query("daily_vectors_dense", CAT + "SELECT d AS day, round(coalesce(sum(mag), 0), 6) AS gain, count(event_id) AS events FROM (SELECT CAST(unnest(range(19720, 19760)) AS INTEGER) AS d) LEFT JOIN cat ON day = d AND mag >= 2.5 GROUP BY ALL")
def daily_vectors_dense(spark, sf_dir):
    return scoring.daily_vectors(cat(spark, sf_dir).where("mag >= 2.5"), "day", "mag", 19720, 19759).select("day", r("gain", 6).alias("gain"), "events")


@query("epoch_bins", CAT + "SELECT (day - 19723) // 10 AS epoch, count(*) AS events, round(avg(mag), 8) AS mean FROM cat GROUP BY ALL")
def epoch_bins(spark, sf_dir):
    return cat(spark, sf_dir).groupBy(F.expr("cast((day - 19723) div 10 as int)").alias("epoch")).agg(F.count("*").alias("events"), r(F.avg("mag")).alias("mean"))


@query("gain_correlation", CAT + "SELECT region, round(corr(mag, lon), 8) AS correlation FROM cat GROUP BY ALL")
def gain_correlation(spark, sf_dir):
    return cat(spark, sf_dir).groupBy("region").agg(r(F.corr("mag", "lon")).alias("correlation"))


@query("occupancy_probability", CAT + "SELECT t AS threshold, cell, round(sum(n) / 50.0, 8) AS expected, round(count(*) / 50.0, 8) AS probability FROM (SELECT t, cell, user_id % 50 AS c, count(*) AS n FROM cat, (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) v(t) WHERE mag >= t GROUP BY ALL) GROUP BY ALL")
def occupancy_probability(spark, sf_dir):
    sims = cat(spark, sf_dir).withColumn("catalog", F.col("user_id") % 50)
    return scoring.occupancy(sims, 50, [1.0, 2.0]).select("threshold", "cell", r("expected").alias("expected"), r("probability").alias("probability"))


@query("count_quantiles_zero_filled", CAT + "SELECT count(*) AS catalogs, count(*) FILTER (n = 0) AS empty, round(avg(n), 8) AS mean, round(var_pop(n), 8) AS variance, round(quantile_cont(n, 0.025), 8) AS q025, round(quantile_cont(n, 0.5), 8) AS q500, round(quantile_cont(n, 0.975), 8) AS q975 FROM (SELECT user_id, count(*) FILTER (mag >= 2.5) AS n FROM cat GROUP BY ALL)")
def count_quantiles_zero_filled(spark, sf_dir):
    c = cat(spark, sf_dir)
    counts = c.where("mag >= 2.5").groupBy("user_id").agg(F.count("*").alias("n"))
    q = scoring.count_quantiles(counts, c.select("user_id").distinct(), "user_id")
    return q.select("catalogs", "empty", *[r(c).alias(c) for c in ("mean", "variance", "q025", "q500", "q975")])


@query("weighted_quartile", CAT + ", f AS (SELECT cell, count(*) AS n, avg(mag) AS rate FROM cat GROUP BY ALL) SELECT round(quantile_cont(rate, 0.25), 8) AS threshold FROM (SELECT rate, unnest(range(n)) FROM f)")
def weighted_quartile(spark, sf_dir):
    f = cat(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), F.avg("mag").alias("rate"))
    return f.agg(r(F.percentile("rate", F.lit(0.25), F.col("n"))).alias("threshold"))


@query("filtered_aggs", CAT + "SELECT day, count(*) FILTER (region = 'click') AS clicks, max(mag) FILTER (region = 'purchase') IS NOT NULL AS bought, count(DISTINCT user_id) AS users FROM cat GROUP BY ALL")
def filtered_aggs(spark, sf_dir):
    return cat(spark, sf_dir).groupBy("day").agg(F.count_if(F.expr("region = 'click'")).alias("clicks"), F.max(F.when(F.col("region") == "purchase", F.col("mag"))).isNotNull().alias("bought"), F.count_distinct("user_id").alias("users"))


def _decay_sql(first: str, half1: float, second: str, half2: float) -> str:
    """Table s(cell, day, a, b): two decayed sums before each day, day by day, as SQL with a recursion."""
    r1, r2 = 0.5 ** (1 / half1), 0.5 ** (1 / half2)
    step = f"SELECT s.cell, s.day + 1, s.a * {r1!r}::DOUBLE + {first}, s.b * {r2!r}::DOUBLE + {second} FROM s JOIN dense d ON d.cell = s.cell AND d.day = s.day WHERE s.day < (SELECT max(day) FROM days)"
    return CAT.replace("WITH cat0", "WITH RECURSIVE cat0") + f", s(cell, day, a, b) AS (SELECT cell, (SELECT min(day) FROM days), 0.0::DOUBLE, 0.0::DOUBLE FROM grid UNION ALL {step}) "


@query("gamma_poisson_state", _decay_sql("0.5::DOUBLE", 20.0, "d.n", 20.0) + "SELECT cell, day, round(a, 7) AS exposure, round(b, 7) AS mass, round(ln((b + 5) / (a + 5)), 7) AS log_frailty FROM s")
def gamma_poisson_state(spark, sf_dir):
    d = feats.spine(cat(spark, sf_dir), grid(spark))
    d = state.decayed_sum(d, ["cell"], "day", F.lit(0.5), 20.0, "exposure")
    d = state.decayed_sum(d, ["cell"], "day", F.col("n").cast("double"), 20.0, "mass")
    return d.select("cell", "day", r("exposure", 7).alias("exposure"), r("mass", 7).alias("mass"), r(kernels.log_frailty(F.col("exposure"), F.col("mass"), 5.0), 7).alias("log_frailty"))


@query("ewma_trend", _decay_sql("d.n", 3.0, "d.n", 15.0) + f"SELECT cell, day, round(fast - slow, 7) AS trend, round(greatest(fast - slow - 0.5, 0), 7) AS acceleration FROM (SELECT cell, day, a * {1 - 0.5 ** (1 / 3)!r} AS fast, b * {1 - 0.5 ** (1 / 15)!r} AS slow FROM s)")
def ewma_trend(spark, sf_dir):
    d = feats.spine(cat(spark, sf_dir), grid(spark))
    for name, half in (("fast", 3.0), ("slow", 15.0)):
        d = state.decayed_sum(d, ["cell"], "day", F.col("n").cast("double"), half, name).withColumn(name, F.col(name) * (1 - 0.5 ** (1 / half)))
    return d.select("cell", "day", r(F.col("fast") - F.col("slow"), 7).alias("trend"), r(F.greatest(F.col("fast") - F.col("slow") - 0.5, F.lit(0.0)), 7).alias("acceleration"))


@query(
    "hazard_age_state",
    CAT + """, RECURSIVE_PART AS (SELECT 1)
    SELECT cell, day, round(coalesce(0.05::DOUBLE * exp(-o1) * sum(exp(op)) OVER (PARTITION BY cell ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 7) AS age FROM (
      SELECT cell, day, coalesce(sum(0.3::DOUBLE * n) OVER w1, 0) AS o1, coalesce(sum(0.3::DOUBLE * n) OVER w1, 0) AS op FROM dense WINDOW w1 AS (PARTITION BY cell ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""".replace(", RECURSIVE_PART AS (SELECT 1)", ""),
)
def hazard_age_state(spark, sf_dir):
    d = feats.spine(cat(spark, sf_dir), grid(spark)).withColumn("o", 0.3 * F.col("n"))
    return state.hazard_age(d, ["cell"], "day", 0.05, "o").select("cell", "day", r("state", 7).alias("age"))


@query(
    "cusum_state",
    CAT.replace("WITH cat0", "WITH RECURSIVE cat0") + """, s(cell, day, v, q) AS (SELECT cell, 19723, 0.0::DOUBLE, 0.0::DOUBLE FROM grid UNION ALL SELECT s.cell, s.day + 1, greatest(0.0::DOUBLE, s.v * 0.9::DOUBLE + d.n - 1.2::DOUBLE), 0.81::DOUBLE * s.q + 1.2::DOUBLE FROM s JOIN dense d ON d.cell = s.cell AND d.day = s.day WHERE s.day < 19752)
    SELECT cell, day, round(v, 7) AS cusum, round(q, 7) AS variance FROM s""",
)
def cusum_state(spark, sf_dir):
    d = feats.spine(cat(spark, sf_dir), grid(spark))
    return state.cusum(d, ["cell"], "day", F.col("n"), F.lit(1.2), 0.9).select("cell", "day", r("state", 7).alias("cusum"), r("variance", 7).alias("variance"))


_MARGIN = ", mg AS (SELECT b.cell, b.rate, c.n, (c.n - 100) / 25.0::DOUBLE AS score FROM bg b JOIN cnt c USING (cell))"


def _margins(spark, sf_dir):
    b = feats.background(cat(spark, sf_dir), grid(spark), DAYS, 10.0)
    n = cat(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"))
    return b.join(n, "cell", "left").fillna(0, ["n"]).withColumns({"score": (F.col("n") - 100) / 25.0, "all": F.lit(1)})


@query("redistribute_softmax", CAT + _BG + _MARGIN + "SELECT cell, round(t * sum(rate) OVER () / sum(t) OVER (), 7) AS adjusted FROM (SELECT cell, rate, rate * exp(0.4::DOUBLE * score - max(0.4::DOUBLE * score) OVER ()) AS t FROM mg)")
def redistribute_softmax(spark, sf_dir):
    return forecast.softmax_tilt(_margins(spark, sf_dir), ["all"], "rate", "score", 0.4).select("cell", r("adjusted", 7).alias("adjusted"))


@query("bounded_mixture", CAT + _BG + _MARGIN + "SELECT cell, round((0.7::DOUBLE * rate / sum(rate) OVER () + 0.3::DOUBLE * t / sum(t) OVER ()) * sum(rate) OVER (), 7) AS mixed FROM (SELECT cell, rate, rate * exp(least(1.5::DOUBLE * score, 4) - max(least(1.5::DOUBLE * score, 4)) OVER ()) AS t FROM mg)")
def bounded_mixture(spark, sf_dir):
    return forecast.bounded_mixture(_margins(spark, sf_dir), ["all"], "rate", "score", 0.3, 1.5).select("cell", r("mixed", 7).alias("mixed"))


@query("consensus", CAT + "SELECT cell, round(avg(s) * least(greatest((avg((s > 0)::INT) - 0.25) / 0.75, 0), 1), 7) + 0.0 AS consensus FROM (SELECT cell, region, avg(mag) - 2.0 AS s FROM cat GROUP BY ALL) GROUP BY ALL")
def consensus(spark, sf_dir):
    s = cat(spark, sf_dir).groupBy("cell", "region").agg((F.avg("mag") - 2.0).alias("s"))
    return forecast.consensus(s, ["cell"], "s", 0.25).select("cell", r("consensus", 7).alias("consensus"))


@query("reset_weight", CAT + "SELECT event_id, round(least(1.0, pow(10.0, 0.75 * (mag - 2.4))), 8) AS weight FROM cat")
def reset_weight(spark, sf_dir):
    return cat(spark, sf_dir).select("event_id", r(kernels.reset_weight(F.col("mag"), 2.4, 0.75)).alias("weight"))


@query("equilibrium_ensemble", CAT + "SELECT cell, i AS member, round(-ln(1 - ((i * 37 + cell * 11) % 64 + 0.5) / 64), 8) AS age FROM (SELECT DISTINCT cell FROM cat) CROSS JOIN range(64) t(i)")
def equilibrium_ensemble(spark, sf_dir):
    """Stratified equilibrium ages of every cell with events; each cell deals the quantiles to the members in another order."""
    member = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("member")
    rows = known_cells(spark, sf_dir).select("cell", member)
    return rows.select("cell", "member", r(kernels.equilibrium_age((F.col("member") * 37 + F.col("cell") * 11) % 64, 64)).alias("age"))


@query("softmax_gain_by_day", CAT + _TRAIL + """, o AS (SELECT day, n, (n_30 + 1) / 31.0::DOUBLE AS rate, 0.3::DOUBLE * ln(1 + n_7) AS f FROM tr) SELECT day, CAST(sum(n) AS BIGINT) AS events, round(sum(n * f) - sum(n) * (ln(sum(rate * exp(f))) - ln(sum(rate))), 6) AS gain FROM o GROUP BY ALL""")
def softmax_gain_by_day(spark, sf_dir):
    t = feats.trailing(feats.spine(cat(spark, sf_dir), grid(spark)), (7, 30)).withColumn("rate", (F.col("n_30") + 1.0) / 31)
    return forecast.conditional_gain(t, "day", "rate", 0.3 * F.log1p(F.col("n_7")), "n").select("day", "events", r("gain", 6).alias("gain"))


@query("feature_standardize_clip", CAT + _TRAIL + ", m AS (SELECT avg(ln(1 + n_7)) AS a, stddev_pop(ln(1 + n_7)) AS s FROM tr) SELECT cell, day, round(least(greatest((ln(1 + n_7) - a) / s, -3), 3), 7) AS feature FROM tr, m")
def feature_standardize_clip(spark, sf_dir):
    t = feats.trailing(feats.spine(cat(spark, sf_dir), grid(spark)), (7,)).withColumn("f", F.log1p("n_7"))
    m = t.agg(F.avg("f").alias("a"), F.stddev_pop("f").alias("s"))
    z = (F.col("f") - F.col("a")) / F.when(F.col("s") < 1e-12, 1.0).otherwise(F.col("s"))
    return t.crossJoin(F.broadcast(m)).select("cell", "day", r(F.least(F.greatest(z, F.lit(-3.0)), F.lit(3.0)), 7).alias("feature"))


@query("missed_streaks", CAT + "SELECT region, CAST(min(day) AS INTEGER) AS first, CAST(max(day) AS INTEGER) AS last, count(*) AS length FROM (SELECT region, day, day - row_number() OVER (PARTITION BY region ORDER BY day) AS i FROM (SELECT DISTINCT region, day FROM cat WHERE mag >= 2.35)) GROUP BY region, i")
def missed_streaks(spark, sf_dir):
    return state.runs(cat(spark, sf_dir).where("mag >= 2.35"), ["region"], "day")


@query("event_identity", "SELECT event_id, sha256(event_type || chr(10) || event_id || chr(10) || user_id) AS key FROM events")
def event_identity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", identity.key_sha256(F.col("event_type"), F.col("event_id"), F.col("user_id")).alias("key"))


@query("json_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"k":' || json_extract_string(props, '$.k') || ',"region":"' || event_type || '"}' AS canonical FROM events""")
def json_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), identity.canonical_json(region=F.col("event_type"), k=k).alias("canonical"))


@query("email_normalize", "SELECT c_custkey, lower(trim('  ' || replace(c_name, '#', '.') || '@Example.ORG ')) AS email FROM customer")
def email_normalize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", identity.email(F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.ORG "))).alias("email"))


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return catalogs.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey", "o_totalprice")


_ASOF = "WITH f AS (SELECT c_custkey AS k, TIMESTAMP '1996-06-01' + INTERVAL (c_custkey % 500) DAY AS at FROM customer), v AS (SELECT o_custkey AS k, o_orderdate AS since, max(o_orderkey) AS version FROM orders GROUP BY ALL) "


def _as_of(spark, sf_dir, latest):
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("timestamp_ntz'1996-06-01' + make_dt_interval(cast(c_custkey % 500 as int))").alias("at"))
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("since")).agg(F.max("o_orderkey").alias("version"))
    return catalogs.as_of(f, v, "k", "at", "since", latest).select("k", F.col("version_version").alias("version"))


@query("asof_latest_snapshot", _ASOF + "SELECT f.k, v.version FROM f ASOF JOIN v ON f.k = v.k AND f.at >= v.since")
def asof_latest_snapshot(spark, sf_dir):
    return _as_of(spark, sf_dir, True)


@query("asof_earliest_covering", _ASOF + "SELECT f.k, v.version FROM f ASOF JOIN v ON f.k = v.k AND f.at <= v.since")
def asof_earliest_covering(spark, sf_dir):
    return _as_of(spark, sf_dir, False)


@query("anti_join_due", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join_due(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return oplog.insert_absent(table(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey")


@query("artifact_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS artifacts FROM customer")
def artifact_counts(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select("c_custkey")
    return oplog.artifact_counts(runs, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("complete_days", CAT + "SELECT day FROM cat WHERE mag >= 2.25 GROUP BY day HAVING count(DISTINCT region) = 5")
def complete_days(spark, sf_dir):
    return oplog.complete_days(cat(spark, sf_dir).where("mag >= 2.25"), "day", "region", 5)


@query("complete_days_low", CAT + "SELECT day FROM cat WHERE mag >= 2.0 GROUP BY day HAVING count(DISTINCT region) = 5")
def complete_days_low(spark, sf_dir):
    """The same at a magnitude that some days of a small catalogue reach too."""
    return oplog.complete_days(cat(spark, sf_dir).where("mag >= 2.0"), "day", "region", 5)


@query("incident_fold", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, max(o_totalprice) AS o_totalprice, bool_or(o_orderstatus = 'F') AS settled, count(*) AS attempts FROM orders GROUP BY ALL")
def incident_fold(spark, sf_dir):
    log = table(spark, sf_dir, "orders").withColumn("settled", F.col("o_orderstatus") == "F")
    return oplog.folded(log, ["o_custkey"], ["o_orderstatus"], ["o_orderpriority"], ["settled"], ["o_totalprice"], "o_orderkey")


@query("trailing_streak", "WITH l AS (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS done FROM orders) SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O' AND (done IS NULL OR o_orderkey > done)) AS streak FROM l GROUP BY ALL")
def trailing_streak(spark, sf_dir):
    return oplog.trailing_streak(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus", "O", "F")


@query("window_gap_check", "SELECT o_custkey, start, \"end\" FROM (SELECT *, lag(\"end\") OVER (PARTITION BY o_custkey ORDER BY start, \"end\") AS before FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 30 AS \"end\" FROM orders)) WHERE before IS NOT NULL AND before <> start")
def window_gap_check(spark, sf_dir):
    start = F.to_date("o_orderdate")
    w = table(spark, sf_dir, "orders").select("o_custkey", start.alias("start"), F.date_add(start, 30).alias("end")).distinct()
    return catalogs.gaps(w, ["o_custkey"]).select("o_custkey", "start", "end")


@query("sliding_windows", CAT + "SELECT region, CAST(d AS INTEGER) AS window_end, count(*) AS n FROM cat, (SELECT unnest(range(19723, 19783)) AS d) WHERE day < d AND day >= d - 30 GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    ends = F.explode(F.sequence(F.col("day") + 1, F.col("day") + 30)).alias("window_end")
    return cat(spark, sf_dir).groupBy("region", "day").agg(F.count("*").alias("k")).select("region", "k", ends).groupBy("region", "window_end").agg(F.sum("k").alias("n"))


@query("content_identity", "SELECT sha256(text) AS identity, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def content_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(identity.sha256(F.col("text")).alias("identity")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("region_delivery_join", "SELECT r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def region_delivery_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("r_name").agg(F.count("*").alias("customers"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("month_shards", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY ALL")
def month_shards(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))


_GRAPH = f", sec AS ({_SECTIONS}), sg AS (SELECT *, (section * 53 % 180)::DOUBLE AS strike, section % 2 AS model FROM sec)"


@query(
    "section_coupling",
    CAT + _GRAPH + """ SELECT a.section AS src, b.section AS dst, round(exp(-0.5::DOUBLE * ((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2) / 2.25::DOUBLE) * (0.3::DOUBLE + 0.7::DOUBLE * cos(radians(a.strike - b.strike)) ** 2), 8) AS weight
      FROM sg a JOIN sg b ON a.model = b.model AND a.section <> b.section AND (a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2 <= 9""",
)
def section_coupling(spark, sf_dir):
    s = sections(spark, sf_dir).withColumns({"strike": (F.col("section") * 53 % 180).cast("double"), "model": F.col("section") % 2})
    return particles.each_pair(particles.coupled_lists(s, 1.5, 0.3, 3.0).withColumn("weight", r("weight")))  # rounded once a list


@query("loading_vector", CAT + _GRAPH + ", c AS (SELECT section, model, sx - avg(sx) OVER (PARTITION BY model) AS c FROM sg) SELECT section, round(c / sqrt(avg(c * c) OVER (PARTITION BY model)), 8) + 0.0 AS loading FROM c")
def loading_vector(spark, sf_dir):
    s = sections(spark, sf_dir).withColumn("model", F.col("section") % 2)
    return particles.centred_loading(s, ["model"], "sx").select("section", r("loading").alias("loading"))


@query(
    "history_hash",
    CAT + "SELECT day, sha256(string_agg(h, '' ORDER BY cell)) AS identity FROM (SELECT day, cell, sha256(string_agg(us || ',' || event_id, ';' ORDER BY us, event_id)) AS h FROM cat GROUP BY ALL) GROUP BY ALL",
)
def history_hash(spark, sf_dir):
    """Order-dependent identity of each day of history, hashed cell by cell and then day by day, so no task holds a history."""
    item = F.struct("us", "event_id", F.concat_ws(",", F.col("us").cast("string"), F.col("event_id").cast("string")).alias("t"))
    cells_ = cat(spark, sf_dir).groupBy("day", "cell").agg(F.sort_array(F.collect_list(item)).alias("s"))
    hashed = cells_.select("day", "cell", F.sha2(F.array_join(F.transform("s", lambda x: x["t"]), ";"), 256).alias("h"))
    days = hashed.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("cell", "h"))).alias("s"))
    return days.select("day", F.sha2(F.array_join(F.transform("s", lambda x: x["h"]), ""), 256).alias("identity"))
