"""Published tables: month shards with a manifest of their content, put in place in one step and read only if they agree with it.

A table is written beside its place and renamed when its manifest is complete, so readers see all of it or nothing. The manifest has
a row for each month: first and last day, rows, days and an order-free hash of the content. Reading a period takes whole
shards only, prunes the scan to them and, unless told otherwise, compares their content with the manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorloom.functions import geo

#: Buckets of a shard's row hashes; bounds the list that a shard's hash is taken over.
BUCKETS = 256


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to a place that must be free."""
    a, files = _path(spark, source)
    b, _ = _path(spark, target)
    files.mkdirs(b.getParent())
    if files.exists(b) or not files.rename(a, b):
        raise FileExistsError(f"{target} is taken")


def removed(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    at, files = _path(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def month_of(day: str) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(day)), "yyyy-MM")


def shard_summary(rows: DataFrame, day: str = "day") -> DataFrame:
    """(month, first_day, last_day, rows, days, content) of rows (month, day, ...): the manifest of what is there.

    The content is a hash over sums of row hashes, so neither order nor files matter; every column counts, by its name.
    """
    columns = sorted(c for c in rows.columns if c != "month")
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    hashed = rows.select("month", F.col(day).alias("d"), F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").alias("h"))
    parts = hashed.groupBy("month", F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.sum("h").alias("s"), F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = hashed.groupBy("month").agg(F.count_distinct("d").alias("days"))
    content = F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("b", "s", "n")))), 256)
    return parts.groupBy("month").agg(F.min("lo").alias("first_day"), F.max("hi").alias("last_day"), F.sum("n").alias("rows"), content.alias("content")).join(days, "month").select("month", "first_day", "last_day", "rows", "days", "content")


def publish(rows: DataFrame, folder: str, day: str = "day") -> DataFrame:
    """Write rows as month shards with a manifest under folder, which must not exist, and return the manifest.

    The manifest is of the rows as they are read back. What a failed attempt leaves beside the folder is never read.
    """
    spark = rows.sparkSession
    if exists(spark, folder):
        raise FileExistsError(f"{folder} is taken")
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    rows.withColumn("month", month_of(day)).repartition("month", F.pmod(F.hash(day), F.lit(8))).write.partitionBy("month").parquet(f"{staging}/shards")
    shard_summary(_shards(spark, staging), day).coalesce(1).write.parquet(f"{staging}/manifest")
    moved(spark, staging, folder)
    return manifest(spark, folder)


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/shards")
    return rows.withColumn("month", F.col("month").cast("string"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def period_shards(listed: DataFrame, first: int, end: int) -> list[str]:
    """Months of a manifest that make up the days from first to before end; a shard that is cut, or none at all, is an error."""
    met = [r for r in listed.collect() if r["last_day"] >= first and r["first_day"] < end]  # a row a month
    if torn := [r["month"] for r in met if r["first_day"] < first or r["last_day"] >= end]:
        raise ValueError(f"the period cuts shards {sorted(torn)}")
    if not met:
        raise ValueError("the period has no shard")
    return sorted(r["month"] for r in met)


def read_period(spark: SparkSession, folder: str, first: int, end: int, day: str = "day", verify: bool = True) -> DataFrame:
    """The rows of whole shards of a period; shards whose content is not what the manifest says are an error."""
    months = period_shards(manifest(spark, folder), first, end)
    rows = _shards(spark, folder).where(F.col("month").isin(months))
    if verify:
        said = manifest(spark, folder).where(F.col("month").isin(months))
        if bad := sorted(r["month"] for r in said.exceptAll(shard_summary(rows, day)).collect()):
            raise ValueError(f"shards {bad} differ from their manifest")
    return rows


def joined(spark: SparkSession, left: str, right: str, keys: Sequence[str], first: int, end: int, day: str = "day", verify: bool = True) -> DataFrame:
    """Two published tables joined one to one on keys over a period.

    They must list the same months with the same days, and have the same keys, each once; anything else is an error, so no row is
    lost or doubled.
    """
    a, b = manifest(spark, left), manifest(spark, right)
    both = a.alias("a").join(b.alias("b"), "month", "full").select("month", F.col("a.first_day").alias("a1"), F.col("b.first_day").alias("b1"), F.col("a.last_day").alias("a2"), F.col("b.last_day").alias("b2")).collect()
    if lone := sorted(r["month"] for r in both if r["a1"] is None or r["b1"] is None):
        raise ValueError(f"months {lone} are in one manifest alone")
    if apart := sorted(r["month"] for r in both if (r["a1"], r["a2"]) != (r["b1"], r["b2"])):
        raise ValueError(f"periods differ for {apart}")
    x, y = (read_period(spark, f, first, end, day, verify) for f in (left, right))
    for side, rows in (("left", x), ("right", y)):
        if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"keys repeat in the {side} table")
    if not x.select(*keys).exceptAll(y.select(*keys)).isEmpty() or not y.select(*keys).exceptAll(x.select(*keys)).isEmpty():
        raise ValueError("the tables have different keys")
    return x.join(y.drop("month", *[c for c in y.columns if c in x.columns and c not in keys]), list(keys))


def selection_counts(catalogue: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """One row: events read, without magnitude, outside the box, outside the polygon, and included; each is counted once."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    box = F.col("lon").between(min(xs), max(xs)) & F.col("lat").between(min(ys), max(ys))
    reason = F.when(F.col("mag").isNull(), "without_magnitude").when(F.col("lon").isNull() | F.col("lat").isNull() | ~box, "outside_box").when(~geo.in_polygon(F.col("lon"), F.col("lat"), polygon), "outside_polygon").otherwise("included")
    flagged = catalogue.select(reason.alias("reason"))
    return flagged.agg(F.count("*").alias("read"), *[F.count_if(F.col("reason") == n).alias(n) for n in ("without_magnitude", "outside_box", "outside_polygon", "included")])


def export_catalogue(catalogue: DataFrame, polygon: Sequence[tuple[float, float]], folder: str) -> tuple[DataFrame, DataFrame]:
    """Publish the events with a magnitude inside a polygon; (manifest, counts). Counts that the manifest does not match are an error."""
    counts = selection_counts(catalogue, polygon)
    listed = publish(catalogue.where(F.col("mag").isNotNull() & geo.in_polygon(F.col("lon"), F.col("lat"), polygon)), folder)
    if (listed.agg(F.sum("rows")).first()[0] or 0) != counts.first()["included"]:
        raise ValueError("the catalogue changed during its export")
    return listed, counts
