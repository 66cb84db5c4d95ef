"""Queries over polylines: a trace for every supplier, the events' places moved across the antimeridian."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorloom.functions import geo
from tremorloom.operators import traces
from tremorloom.plans.point_process import CAT, cat, r
from tremorloom.plans.registry import query
from tremorloom.session import table

#: Degrees of longitude that everything is moved east by, so that half of it lies beyond 180.
SHIFT = 175.0
NEAREST, REACH = 4, 60.0
BANDWIDTH, CUTOFF, ODDS, LENGTH, FLOOR = 40.0, 90.0, 2.0, 25.0, 0.25

_WRAP = "((({0}) + 180.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE"
_K = "(pi() * 6371.0088::DOUBLE / 180)"


def event_points(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return c.select(F.col("event_id").alias("point"), "lat", geo.wrapped_longitude(F.col("lon") + SHIFT).alias("lon"))


def section_traces(spark, sf_dir) -> DataFrame:
    """Traces of two to five vertices, with the models that they belong to and the margin that their account has."""
    s, j = F.col("s_suppkey"), F.col("j")
    lat = (s * 61 % 100) / 10.0 + j * (s % 7 - 3) / 12.0
    lon = geo.wrapped_longitude((s * 37 % 100) / 10.0 + j * (s % 11 - 5) / 10.0 + SHIFT)
    vertices = table(spark, sf_dir, "supplier").withColumn("j", F.explode(F.sequence(F.lit(0), (1 + s % 4).cast("int")))).select(s.alias("section"), "s_acctbal", F.struct(j.alias("j"), lat.alias("lat"), lon.alias("lon")).alias("v"))
    kept = vertices.groupBy("section").agg(F.sort_array(F.collect_list("v")).alias("v"), F.first("s_acctbal").alias("acct"))
    models = F.when(F.col("section") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("section") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    return kept.select("section", F.transform("v", lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"))).alias("vertices"), models.alias("models"), (F.col("acct") / 1000.0).alias("margin"))


_TRACES = f"""
, pts AS (SELECT event_id AS point, lat, {_WRAP.format(f"lon + {SHIFT}::DOUBLE")} AS lon FROM cat)
, vert AS (SELECT s_suppkey AS section, s_acctbal / 1000.0::DOUBLE AS margin, j, (s_suppkey * 61 % 100) / 10.0::DOUBLE + j * (s_suppkey % 7 - 3) / 12.0::DOUBLE AS lat,
    {_WRAP.format(f"(s_suppkey * 37 % 100) / 10.0::DOUBLE + j * (s_suppkey % 11 - 5) / 10.0::DOUBLE + {SHIFT}::DOUBLE")} AS lon FROM (SELECT *, unnest(range(2 + s_suppkey % 4)) AS j FROM supplier))
, seg AS (SELECT a.section, a.j, a.lat AS lat0, a.lon AS lon0, b.lat - a.lat AS dlat, {_WRAP.format("b.lon - a.lon")} AS dlon, cos(radians((a.lat + b.lat) * 0.5::DOUBLE)) AS c
    FROM vert a JOIN vert b ON b.section = a.section AND b.j = a.j + 1)
, placed AS (SELECT point, section, {_WRAP.format("lon - lon0")} AS dx, lat - lat0 AS dy, c, dlat, dlon FROM pts CROSS JOIN seg)
, planar AS (SELECT point, section, dx * {_K} * c AS x, dy * {_K} AS y, dlon * {_K} * c AS sx, dlat * {_K} AS sy FROM placed)
, cut AS (SELECT *, CASE WHEN sx * sx + sy * sy = 0 THEN 0 ELSE least(greatest((x * sx + y * sy) / (sx * sx + sy * sy), 0), 1) END AS t FROM planar)
, apart AS (SELECT point, section, min(sqrt((x - t * sx) ** 2 + (y - t * sy) ** 2)) AS distance FROM cut GROUP BY ALL)
, near AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY distance, section) AS rank FROM apart QUALIFY rank <= {NEAREST})
"""


@query("trace_distance", CAT + _TRACES + "SELECT point, section, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM near")
def trace_distance(spark, sf_dir):
    """The nearest traces of every event."""
    return traces.nearest_traces(event_points(spark, sf_dir), section_traces(spark, sf_dir), NEAREST).select("point", "section", r("distance", 5).alias("distance"), "rank")


def _end(s: str, end: int) -> tuple[str, str]:
    wrapped = _WRAP.format(f"{s}.lon0 + {end} * {s}.dlon - first_lon")
    return f"(({wrapped}) * {_K} * cos(radians(mid)))", f"(({s}.lat0 + {end} * {s}.dlat - mid) * {_K})"


def _to_segment(p: str, a: str, b: str) -> str:
    dx, dy = f"({b}x - {a}x)", f"({b}y - {a}y)"
    t = f"(CASE WHEN {dx} * {dx} + {dy} * {dy} = 0 THEN 0 ELSE least(greatest((({p}x - {a}x) * {dx} + ({p}y - {a}y) * {dy}) / ({dx} * {dx} + {dy} * {dy}), 0), 1) END)"
    return f"sqrt(({p}x - {a}x - {t} * {dx}) ** 2 + ({p}y - {a}y - {t} * {dy}) ** 2)"


_PLACES = ", ".join(f"{x} AS {n}x, {y} AS {n}y" for n, (x, y) in zip("pqmw", (_end("s", 0), _end("s", 1), _end("t", 0), _end("t", 1)), strict=True))
_ACROSS = "((qx - px) * (wy - my) - (qy - py) * (wx - mx))"
_PAIRS = f"""
, mean AS (SELECT section, sum(lat) AS lat_sum, count(*) AS n, min(lon) FILTER (j = 0) AS first_lon FROM vert GROUP BY ALL)
, both_ AS (SELECT a.section AS src, b.section AS dst, (a.lat_sum + b.lat_sum) / (a.n + b.n) AS mid, a.first_lon FROM mean a JOIN mean b ON a.section < b.section)
, ends AS (SELECT src, dst, {_PLACES} FROM both_ JOIN seg s ON s.section = src JOIN seg t ON t.section = dst)
, cross_ AS (SELECT *, CASE WHEN abs({_ACROSS}) > 1e-12 THEN ((mx - px) * (wy - my) - (my - py) * (wx - mx)) / {_ACROSS} END AS u, CASE WHEN abs({_ACROSS}) > 1e-12 THEN ((mx - px) * (qy - py) - (my - py) * (qx - px)) / {_ACROSS} END AS v FROM ends)
, far AS (SELECT src, dst, min(CASE WHEN u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 THEN 0 ELSE least({_to_segment("p", "m", "w")}, {_to_segment("q", "m", "w")}, {_to_segment("m", "p", "q")}, {_to_segment("w", "p", "q")}) END) AS distance FROM cross_ GROUP BY ALL)
, sym AS (SELECT src, dst, distance FROM far UNION ALL SELECT dst, src, distance FROM far)
"""


@query("trace_pairs", CAT + _TRACES + _PAIRS + f"SELECT src, dst, round(distance, 5) AS distance FROM sym WHERE distance <= {REACH}")
def trace_pairs(spark, sf_dir):
    return traces.trace_pairs(section_traces(spark, sf_dir), REACH).select("src", "dst", r("distance", 5).alias("distance"))


_STRIKE = f"""
, flat AS (SELECT section, dlat * {_K} AS n, dlon * {_K} * cos(radians(lat_sum / m.n)) AS e FROM seg JOIN mean m USING (section))
, strike AS (SELECT section, ((degrees(atan2(sum(sqrt(n * n + e * e) * sin(2 * atan2(e, n))), sum(sqrt(n * n + e * e) * cos(2 * atan2(e, n))))) / 2) % 180 + 180) % 180 AS strike, sum(abs(n) + abs(e)) AS moved FROM flat GROUP BY ALL)
"""


def moving_traces(spark, sf_dir) -> DataFrame:
    """Traces that are longer than a point: where both steps are zero, all vertices are one."""
    return section_traces(spark, sf_dir).where("section % 7 <> 3 OR section % 11 <> 5")


@query("trace_strike", CAT + _TRACES + _PAIRS + _STRIKE + "SELECT section, round(strike, 6) AS strike FROM strike WHERE moved > 0")
def trace_strike(spark, sf_dir):
    return traces.strikes(moving_traces(spark, sf_dir)).select("section", r("strike", 6).alias("strike"))


@query(
    "trace_graph",
    CAT + _TRACES + _PAIRS + _STRIKE + f"""SELECT src, dst, round(distance, 5) AS distance, round(exp(-0.5::DOUBLE * (distance / {LENGTH}::DOUBLE) ** 2) * ({FLOOR} + {1 - FLOOR} * cos(radians(a.strike - b.strike)) ** 2), 8) AS weight
    FROM sym JOIN strike a ON a.section = src AND a.moved > 0 JOIN strike b ON b.section = dst AND b.moved > 0 WHERE distance <= {traces.UNDERFLOW * LENGTH} AND (src % 3 = 0 OR dst % 3 = 0 OR src % 3 = dst % 3)""",
)
def trace_graph(spark, sf_dir):
    """The whole weighted graph: no edge of a weight above zero is left out."""
    g = traces.trace_graph(moving_traces(spark, sf_dir), LENGTH, FLOOR)
    return g.select("src", "dst", r("distance", 5).alias("distance"), r("weight").alias("weight"))


_ASSIGNED = f"""
, weighed AS (SELECT point, section, {ODDS}::DOUBLE * exp(-0.5::DOUBLE * (distance / {BANDWIDTH}::DOUBLE) ** 2) AS w FROM apart WHERE distance <= {CUTOFF})
, assigned AS (SELECT pts.point, section, coalesce(w, 0) / (1 + coalesce(sum(w) OVER (PARTITION BY pts.point), 0)) AS p, 1 / (1 + coalesce(sum(w) OVER (PARTITION BY pts.point), 0)) AS off FROM pts LEFT JOIN weighed USING (point))
"""


def assignment(spark, sf_dir) -> traces.Assignment:
    return traces.assigned(event_points(spark, sf_dir), section_traces(spark, sf_dir), BANDWIDTH, CUTOFF, ODDS)


@query("section_assignment", CAT + _TRACES + _ASSIGNED + "SELECT point, section, round(p, 8) AS p, round(off, 8) AS off FROM assigned")
def section_assignment(spark, sf_dir):
    found = assignment(spark, sf_dir)
    rounded = found.chances.withColumns({"p": r("p"), "off": r("off")})  # once a place and shape
    return replace(found, chances=rounded).rows()


@query(
    "margin_projection",
    CAT + _TRACES + f"""SELECT point, round(coalesce(sum(w * margin) / nullif(sum(w), 0), 0), 8) AS margin FROM (SELECT point, margin, CASE WHEN distance <= {CUTOFF} THEN exp(-0.5::DOUBLE * (distance / {BANDWIDTH}::DOUBLE) ** 2) ELSE 0 END AS w
    FROM near JOIN (SELECT section, any_value(margin) AS margin FROM vert GROUP BY ALL) USING (section)) GROUP BY ALL""",
)
def margin_projection(spark, sf_dir):
    t = section_traces(spark, sf_dir)
    places, at = traces.places(event_points(spark, sf_dir))
    margins = traces.projected_margin(traces.nearest_traces(places, t, NEAREST), t, BANDWIDTH, CUTOFF)
    return at.join(margins.withColumnRenamed("point", "place"), "place").select("point", r("margin").alias("margin"))


@query(
    "state_projection",
    CAT + _TRACES + _ASSIGNED + """SELECT CAST(particle AS INTEGER) AS particle, point, round(sum(p * (margin + particle * sin(section))), 7) AS margin FROM assigned JOIN (SELECT section, any_value(margin) AS margin FROM vert GROUP BY ALL) USING (section)
    CROSS JOIN range(3) t(particle) GROUP BY ALL""",
)
def state_projection(spark, sf_dir):
    """Three particles' section states at every event."""
    particle = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("particle")
    states = section_traces(spark, sf_dir).select(particle, "section", "margin").withColumn("margin", F.col("margin") + F.col("particle") * F.sin("section"))
    return assignment(spark, sf_dir).states(states).select("particle", "point", r("margin", 7).alias("margin"))


@query("scattered_mass", CAT + _TRACES + _ASSIGNED + "SELECT section, round(sum(p * mag), 6) AS mass FROM assigned JOIN cat ON event_id = point WHERE section IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL::BIGINT, round((SELECT sum(mag) FROM cat) - sum(p * mag), 6) FROM assigned JOIN cat ON event_id = point")
def scattered_mass(spark, sf_dir):
    mass = cat(spark, sf_dir).select(F.col("event_id").alias("point"), F.col("mag").alias("mass"))
    return assignment(spark, sf_dir).scattered(mass).select("section", r("mass", 6).alias("mass"))
