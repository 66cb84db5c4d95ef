"""Catalogue operators: the event view, cleaning, counting, first-wins dedup, windows and as-of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.functions import kernels

EPOCH = "1970-01-01"


def epoch_day(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date"))


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), ts)


def catalogue(events: DataFrame, step: float = 0.1) -> DataFrame:
    """Events as a marked point process on a 10 by 10 grid: one narrow projection, so the scan reads five columns."""
    cell = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", "ts", "user_id", F.col("event_type").alias("region"), "value", cell.alias("cell")).select(
        "event_id",
        "ts",
        epoch_day(F.col("ts")).alias("day"),
        epoch_micros(F.col("ts")).alias("us"),
        "user_id",
        "region",
        "value",
        "cell",
        (F.col("cell") % 10).alias("x"),
        F.expr("cast(cell div 10 as int)").alias("y"),
        (F.col("cell") % 10 + (F.col("user_id") % 10) / 10.0).alias("lon"),
        (F.expr("cell div 10") + (F.col("event_id") % 10) / 10.0).alias("lat"),
        kernels.rounded_magnitude(F.log10(F.col("value") + 1), step).alias("mag"),
    )


def selected(cat: DataFrame, first_day: int, end_day: int, least: float) -> DataFrame:
    """Half-open days and a magnitude threshold; the days also as bounds of ts, which reach the scan."""
    kind = cat.schema["ts"].dataType
    start, end = (F.date_add(F.lit(EPOCH).cast("date"), d).cast(kind) for d in (first_day, end_day))
    return cat.where((F.col("ts") >= start) & (F.col("ts") < end)).where((F.col("day") >= first_day) & (F.col("day") < end_day) & (F.col("mag") >= least))


def source_counts(cat: DataFrame, least: float, first_day: int, end_day: int) -> DataFrame:
    """Conditional counts in one pass."""
    inside = (F.col("day") >= first_day) & (F.col("day") < end_day)
    return cat.agg(
        F.count("*").alias("rows"), F.count_if(inside).alias("in_period"), F.count_if(F.col("mag") >= least).alias("above"), F.count_if(inside & (F.col("mag") >= least)).alias("selected"), F.count_if(F.col("mag").isNull()).alias("without_magnitude")
    )


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in a total order; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def gaps(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows (start, end) that do not begin where the one before them ended."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return windows.withColumn("before", F.lag("end").over(w)).where("before IS NOT NULL AND before <> start")


def year_windows(start: Column, end: Column) -> Column:
    """Array of (start, end) of the calendar years that a period touches, cut to the period."""
    years = F.sequence(F.date_trunc("year", start), end - F.expr("interval 1 microsecond"), F.expr("interval 1 year"))
    return F.transform(years, lambda y: F.struct(F.greatest(y, start).alias("start"), F.least(y + F.expr("interval 1 year"), end).alias("end")))


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, since: str, latest: bool = True) -> DataFrame:
    """Each fact with the latest version at or before its time, or the earliest at or after it; facts without one go.

    One shuffle on the key: versions and facts are unioned and a running last (or first) value over the sorted rows picks.
    """
    v = versions.select(key, F.col(since).alias("_t"), F.struct(*versions.columns).alias("_v"), F.lit(None).alias("_f"))
    f = facts.select(key, F.col(at).alias("_t"), F.lit(None).alias("_v"), F.struct(*facts.columns).alias("_f"))
    both = v.unionByName(f)
    kind = F.col("_f").isNotNull()
    if latest:
        w = Window.partitionBy(key).orderBy("_t", kind.asc()).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_v", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(key).orderBy(F.col("_t").desc(), kind.asc()).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_v", ignorenulls=True).over(w)
    return both.withColumn("_v", found).where("_f IS NOT NULL AND _v IS NOT NULL").select("_f.*", *[F.col(f"_v.{c}").alias(f"version_{c}") for c in versions.columns if c != key])


def joined_periods(first: DataFrame, second: DataFrame, day: str = "day") -> DataFrame:
    """Both tables by column name; the second must start on the day after the last of the first, otherwise ValueError."""
    end, start = first.agg(F.max(day)).first()[0], second.agg(F.min(day)).first()[0]
    if end is not None and start is not None and start != end + 1:
        raise ValueError(f"the second period starts on day {start}, the first ends on day {end}")
    return first.unionByName(second)


def prefix_differences(stored: DataFrame, current: DataFrame, end_day: int, day: str = "day") -> DataFrame:
    """(missing, extra): rows of current before end_day that stored lacks, and rows that only stored has; repeated rows count."""
    columns = stored.columns
    signed = stored.select(*columns, F.lit(1).alias("side_")).unionByName(current.where(F.col(day) < end_day).select(*columns, F.lit(-1).alias("side_")))
    net = signed.groupBy(*columns).agg(F.sum("side_").alias("net_"))
    return net.agg(*[F.coalesce(F.sum(F.greatest(sign * F.col("net_"), F.lit(0))), F.lit(0)).alias(n) for n, sign in (("missing", -1), ("extra", 1))])
