"""Late data in append-only state: counts for days that were missed, new versions in place of updates, paths set in JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earliest_covering(windows: DataFrame, snapshots: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """windows (keys, start, end) with the first snapshot (keys, snapshot, from, until, order) that covers them; others go.

    Snapshots meet windows by their keys and are combined before they are ranked: only the least of a window is kept.
    """
    met = windows.join(snapshots, list(keys)).where((F.col("from") <= F.col("start")) & (F.col("until") >= F.col("end")))
    return met.groupBy(*keys, "start", "end").agg(F.min(F.struct(*order, "snapshot")).alias("s")).select(*keys, "start", "end", F.col("s.snapshot").alias("snapshot"))


def counted(windows: DataFrame, events: DataFrame, keys: Sequence[str], width: int, more: Column | None = None) -> DataFrame:
    """windows (keys, start, end, ...) with n, the events (keys, at) from start to before end, 0 where there is none.

    An interval join by bins of `width`: a window is dealt to the bins that it touches and meets the events of each by key; more
    is a further condition on the pair. Windows that repeat are counted once.
    """
    names = windows.columns
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / width))
    dealt = windows.distinct().withColumn("bin_", F.explode(bins))
    met = dealt.join(events.withColumn("bin_", F.floor(F.col("at") / width)), [*keys, "bin_"]).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")) & (F.lit(True) if more is None else more))
    counts = met.groupBy(*names).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for c in names:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return windows.distinct().alias("a").join(counts.alias("b"), same, "left").select(*[F.col(f"a.{c}").alias(c) for c in names], F.coalesce("b.n", F.lit(0)).alias("n"))


def latest(log: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The newest version of every key."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def versions(log: DataFrame, changes: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """Rows to append to a log so that its newest versions have the values of changes: an update by another table.

    Only keys that the log has and whose values differ get a new version; columns that changes lack are taken over. A key that
    changes has more than once is an error.
    """
    twice = F.raise_error(F.concat(F.lit("several changes for "), F.to_json(F.struct(*keys)))).cast("boolean")
    once = changes.withColumn("_c", F.count("*").over(Window.partitionBy(*keys))).where(F.when(F.col("_c") > 1, twice).otherwise(True)).drop("_c")
    values = [c for c in changes.columns if c not in keys]
    met = latest(log, keys, version).join(once.withColumnsRenamed({c: f"new_{c}" for c in values}), list(keys))
    differs = F.lit(False)
    for c in values:
        differs |= ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    fresh = met.where(differs).withColumns({c: F.col(f"new_{c}") for c in values}).withColumn(version, F.col(version) + 1)
    return fresh.select(*log.columns)


def json_set(text: Column, name: str, value: Column) -> Column:
    """A JSON object with one top-level member set to a value, the others as they are; members come in order of their names.

    Null, and text that is no object, count as an empty object.
    """
    members = F.coalesce(F.from_json(text, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    others = F.map_filter(members, lambda k, _: k != name)
    entry = F.map_from_arrays(F.array(F.lit(name)), F.array(F.try_parse_json(F.coalesce(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2), F.lit("null")))))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(others, entry)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return F.to_json(ordered)
