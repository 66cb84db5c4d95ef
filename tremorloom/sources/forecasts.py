"""Catalogue forecasts as text: events of many simulated catalogues, where a catalogue without events still has a line."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorloom.functions import kernels
from tremorloom.sources.published import moved

SCHEMA = "lon double, lat double, magnitude double, time_string string, depth double, catalog_id long, event_id string"


def write_forecast(events: DataFrame, members: DataFrame, folder: str, start, step: float = 0.1) -> None:
    """Write events (catalog, t in days after start, x, y, mag) of the catalogues in members (catalog) as CSV, in one step.

    Magnitudes are rounded half up to a multiple of step; events are numbered in order of time within their catalogue; a
    catalogue without events is a line with its number alone. An event of a catalogue that members lacks is an error.
    """
    unknown = F.raise_error(F.concat(F.lit("unknown catalogue "), F.col("catalog").cast("string"))).cast("boolean")
    known = members.select(F.col("catalog").cast("long").alias("catalog")).distinct().withColumn("known", F.lit(True))
    rows = known.join(events.withColumn("given", F.lit(True)), "catalog", "full").where(F.when(F.col("known").isNull(), unknown).otherwise(True))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("catalog").orderBy("t", "x", "y", "mag")) - 1
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.round(F.col("t") * 86_400_000).cast("long") * 1000)
    given = lambda c: F.when(F.col("given"), c)
    lines = rows.select(
        given(F.col("x")).alias("lon"),
        given(F.col("y")).alias("lat"),
        given(F.round(kernels.rounded_magnitude(F.col("mag"), step), 6)).alias("magnitude"),
        given(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("time_string"),
        F.lit(None).cast("double").alias("depth"),
        F.col("catalog").alias("catalog_id"),
        given(F.concat_ws("-", "catalog", number)).alias("event_id"),
    )
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    lines.write.option("header", True).csv(staging)
    moved(events.sparkSession, staging, folder)


def read_forecast(spark: SparkSession, folder: str, start, days: float, least: float) -> tuple[DataFrame, DataFrame]:
    """(events, members): events (catalog, t, x, y, mag) of the window with the least magnitude, and every catalogue listed.

    The schema is declared, so there is no pass for inference, and the bound of the magnitude reaches the scan. Catalogues whose
    events are all left out are members still. A line that has some fields of an event and not others is an error.
    """
    rows = spark.read.schema(SCHEMA).option("header", True).option("mode", "FAILFAST").csv(folder)
    t = (F.unix_micros(F.to_timestamp("time_string")) - F.unix_micros(F.lit(start).cast("timestamp"))) / 86_400_000_000
    fields = [F.col(c).isNull() for c in ("lon", "lat", "magnitude", "time_string")]
    blank, torn = F.lit(True), F.lit(False)
    for f in fields:
        blank, torn = blank & f, torn | f
    broken = F.raise_error(F.concat(F.lit("half an event in catalogue "), F.coalesce(F.col("catalog_id").cast("string"), F.lit("?")))).cast("boolean")
    members = rows.where(F.when((torn & ~blank) | F.col("catalog_id").isNull(), broken).otherwise(True)).select(F.col("catalog_id").alias("catalog")).distinct()
    events = rows.where(F.col("magnitude") >= least).select(F.col("catalog_id").alias("catalog"), t.alias("t"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("magnitude").alias("mag"))
    return events.where((F.col("t") >= 0) & (F.col("t") < days)), members
