"""Sources: pipe-separated event text, fixed-width hypocentre records, catalogue CSV, grid JSON, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Other names of a column in the header of event text.
ALIASES = {"magnitudetype": "magtype", "depthkm": "depth", "depth/km": "depth"}


def event_text(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, origin_time, latitude, longitude, depth, magnitude, magtype, event_type) of pipe-separated text.

    Columns are found by header name; rows that do not parse are dropped; a missing type is an earthquake.
    """
    raw = spark.read.option("sep", "|").option("header", True).csv(path)
    names = {}
    for c in raw.columns:
        plain = c.lower().strip().lstrip("#").strip()
        names[ALIASES.get(plain, plain)] = c
    text = lambda name, default=None: F.col(f"`{names[name]}`") if name in names else F.lit(default)
    number = lambda name: F.expr(f"try_cast(`{names[name]}` AS double)") if name in names else F.lit(None).cast("double")
    rows = raw.select(
        F.trim(text("eventid")).alias("event_id"),
        F.try_to_timestamp(F.regexp_replace(F.trim(text("time")), "Z$", "")).alias("origin_time"),
        number("latitude").alias("latitude"),
        number("longitude").alias("longitude"),
        number("depth").alias("depth"),
        number("magnitude").alias("magnitude"),
        text("magtype").alias("magtype"),
        F.lower(F.coalesce(F.nullif(F.trim(text("eventtype")), F.lit("")), F.lit("earthquake"))).alias("event_type"),
    )
    return rows.where("event_id <> '' AND origin_time IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL")


def _implied(text: Column, places: int) -> Column:
    """A number whose decimal point, if it is not written, stands before the last places."""
    return F.when(F.contains(text, F.lit(".")), text.try_cast("double")).otherwise(text.try_cast("int") / (10**places))


def _left_aligned(text: Column, most: int) -> Column:
    """A left-aligned number whose decimal point, if it is not written, stands where the number is first at most `most`."""
    number = text.try_cast("int")
    divided = F.coalesce(*[F.when(number / d <= most, number / d) for d in (1, 10, 100, 1000, 10_000)])
    return F.when(F.contains(text, F.lit(".")), text.try_cast("double")).otherwise(divided)


def fixed_width(spark: SparkSession, path: str, zone: str = "+09:00") -> DataFrame:
    """(origin_time, latitude, longitude, depth, magnitude, magtype, agency) of fixed-width records of types J, U and I.

    Local times become UTC, degrees and minutes become degrees. A record is left out if its date does not exist, its seconds
    reach 60, or a field that is needed is blank or no number.
    """
    at = lambda a, n: F.trim(F.substring("value", a, n))
    whole = lambda a, n: at(a, n).try_cast("int")
    lines = spark.read.text(path).where("length(value) >= 58 AND substring(value, 1, 1) IN ('J', 'U', 'I')")
    seconds = F.round(_left_aligned(at(14, 4), 60), 6)
    minute = F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:00", whole(2, 4), whole(6, 2), whole(8, 2), whole(10, 2), whole(12, 2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    local = F.when(seconds < 60, F.timestamp_micros(F.unix_micros(minute) + F.round(seconds * 1_000_000).cast("long")))
    rows = lines.select(
        F.to_utc_timestamp(local, zone).alias("origin_time"),
        (whole(22, 3) + _left_aligned(at(25, 4), 60) / 60).alias("latitude"),
        (whole(33, 4) + _left_aligned(at(37, 4), 60) / 60).alias("longitude"),
        at(45, 5).try_cast("double").alias("depth"),
        _implied(at(53, 2), 1).alias("magnitude"),
        at(55, 1).alias("magtype"),
        at(1, 1).alias("agency"),
    )
    return rows.where("origin_time IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND depth IS NOT NULL AND magnitude IS NOT NULL")


#: West, east, south, north and least target magnitude of the named regions; least feature magnitude, largest depth.
REGIONS = {"A": (141.0, 145.0, 36.0, 42.0, 4.5), "B": (145.0, 154.0, 42.0, 47.0, 4.5), "C": (141.0, 154.0, 36.0, 47.0, 5.0)}
FEATURE_MAGNITUDE, DEEPEST = 3.0, 100.0


def in_named_region(rows: DataFrame, name: str, features: bool = False) -> DataFrame:
    """Events of a named region: half-open in place, the depth at most DEEPEST, magnitudes from the target's or the features' on."""
    west, east, south, north, least = REGIONS[name]
    lon, lat = F.col("longitude"), F.col("latitude")
    return rows.where((lon >= west) & (lon < east) & (lat >= south) & (lat < north) & (F.col("depth") <= DEEPEST) & (F.col("magnitude") >= (FEATURE_MAGNITUDE if features else least)))


CATALOGUE_SCHEMA = "event_id string, origin_time timestamp, latitude double, longitude double, depth double, magnitude double"


def catalogue_csv(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Catalogue CSV with its calendar day in a zone; a declared schema, so no pass for inference."""
    rows = spark.read.schema(CATALOGUE_SCHEMA).option("header", True).csv(path)
    return rows.withColumn("day", F.datediff(F.to_date(F.from_utc_timestamp("origin_time", zone)), F.lit("1970-01-01").cast("date")))


def grid_json(spark: SparkSession, path: str) -> DataFrame:
    """(cell, x, y) of a grid definition with integer origins in array origin_units."""
    raw = spark.read.option("multiLine", True).schema("origin_units array<array<int>>").json(path)
    return raw.select(F.posexplode("origin_units").alias("cell", "o")).select("cell", F.col("o")[0].alias("x"), F.col("o")[1].alias("y"))


def in_region(rows: DataFrame, start: Column, end: Column, box: tuple[float, float, float, float], least: float, depth: tuple[float, float]) -> DataFrame:
    """Half-open time, half-open box, magnitude at least, depth half-open; then the first row of each id."""
    west, south, east, north = box
    kept = rows.where((F.col("origin_time") >= start) & (F.col("origin_time") < end) & (F.col("longitude") >= west) & (F.col("longitude") < east) & (F.col("latitude") >= south) & (F.col("latitude") < north) & (F.col("magnitude") >= least) & (F.col("depth") >= depth[0]) & (F.col("depth") < depth[1]))
    from tremorloom.operators.catalog import first_wins

    return first_wins(kept, "event_id", "origin_time", "latitude", "longitude")
