"""Mixing sources to target weights by hash-threshold histograms.

A document is taken as a whole number of copies of all documents of its source plus one more copy for the documents whose
hash lies below the source's threshold. Thresholds come from histograms: sizes are summed by source and hash bucket, the
bucket in which the budget ends is found, and only that bucket is split further, until one hash value decides. Nothing is
sorted, the histogram of a source has at most 4096 rows a level, and thresholds are nested: a larger budget takes a
superset. The hash covers id and text, so reruns agree and repeated rows are taken together.

Null texts have size 0, a null source is a source of its own and the last; sources without words get target 0. An empty
table gives an empty mix. Other columns are kept by mixed_documents and left out of mix_report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, partitions

#: Weights by the sources' rank, repeating; share of all sizes that the mix has; most copies of a document.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CEILING = 2.0
BITS, STEP = 60, 12
#: Sources up to which the thresholds (some 60 bytes each) are broadcast; beyond, the join is salted.
BROADCAST_SOURCES = 20_000
SALTS = 16

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The first 60 bits of the MD5 of id and text."""
    digest = F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.col(text)))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def key_of(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source key, size and hash of every document: all that planning needs."""
    return docs.select("doc_id", key_of().alias("mix_key"), size_of().alias("size"), hash_of().alias("mix_hash"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank by code point, null last, by range partitions and their counts."""
    order = [(F.col("mix_key") == "n").asc(), F.col("mix_key").asc()]
    dealt = cut(sources.repartitionByRange(min(partitions(sources.sparkSession), 64), *order).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    if not before:
        return dealt.withColumn("rank", F.lit(0).cast("long")).drop("part")
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")]
    return dealt.withColumn("rank", offset + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).drop("part")


def budgets(slim: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Per source: source_size and target. Targets above the ceiling stop there and the excess is shared again by weight."""
    sources = slim.groupBy("mix_key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = cut(_ranked(sources).withColumn("weight", weight))
    level, closed = 0.0, -1
    while True:
        full = F.col("source_size") * ceiling <= F.col("weight") * level
        r = ranked.agg(F.sum("source_size"), F.count_if(full), F.sum(F.when(full, F.col("source_size") * ceiling)), F.sum(F.when(~full, F.col("weight")))).first()
        if not r[0] or r[1] == closed or not r[3]:
            break
        closed, level = r[1], (share * r[0] - (r[2] or 0.0)) / r[3]
    return ranked.withColumn("target", F.least(F.col("source_size") * ceiling, F.col("weight") * level)).drop("rank", "weight")


def _in_buckets(slim: DataFrame, goals: DataFrame, level: int) -> DataFrame:
    """Documents in the bucket that their source's budget ends in; the hash prefix in the join key deals out hot sources."""
    if level == 0:
        return slim.withColumn("prefix", F.lit(0).cast("long"))
    return slim.withColumn("prefix", F.shiftright("mix_hash", BITS - STEP * level)).join(goals.select("mix_key", "prefix"), ["mix_key", "prefix"], "left_semi")


def thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: copies of every document, and the hash below which there is one more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    start = targets.withColumn("copies", whole.cast("long")).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    goals = start.withColumns({"prefix": F.lit(0).cast("long")})
    done = []
    for level in range(BITS // STEP):
        shift = BITS - STEP * (level + 1)
        histogram = (
            _in_buckets(slim, goals, level)
            .groupBy("mix_key", F.shiftright("mix_hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("mix_hash").alias("low"), F.max("mix_hash").alias("high"))
        )
        upto = Window.partitionBy("mix_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ended = histogram.withColumn("upto", F.sum("words").over(upto)).join(goals, "mix_key").where(F.col("upto") > F.col("rest"))
        first = ended.groupBy("mix_key").agg(F.min_by(F.struct("bucket", "words", "upto", "low", "high", "rest", "source_size", "target", "copies"), "bucket").alias("b"))
        found = cut(first.select("mix_key", "b.*").withColumn("rest", F.col("rest") - (F.col("upto") - F.col("words"))))
        one = F.col("low") == F.col("high")
        nearer = F.col("words") - F.col("rest") < F.col("rest")
        done.append(found.where(one).select("mix_key", F.when(nearer, F.col("low") + 1).otherwise(F.col("low")).alias("threshold")))
        goals = found.where(~one).select("mix_key", "source_size", "target", "copies", "rest", F.col("bucket").alias("prefix"))
        if goals.isEmpty():
            break
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    # a budget that no bucket exceeds takes everything: rest is then the whole source, to rounding, or nothing
    everything = F.when(F.col("rest") > 0, F.lit(1 << BITS)).otherwise(F.lit(0))
    return cut(start.join(decided, "mix_key", "left").select("mix_key", "source_size", "target", "copies", F.coalesce("threshold", everything).alias("threshold")))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "mix_key")
    salted = plan.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod("mix_hash", F.lit(SALTS)).cast("int")).join(salted, ["mix_key", "salt"]).drop("salt")


def _copies() -> Column:
    return F.col("copies") + F.when(F.col("mix_hash") < F.col("threshold"), 1).otherwise(0)


def mix_report(docs: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, and the words that the mix takes, repeats counted."""
    slim = cut(measured(docs))
    plan = thresholds(slim, budgets(slim, **parameters))
    return _with_plan(slim, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    slim = cut(measured(docs))
    plan = thresholds(slim, budgets(slim, **parameters))
    # the row is carried as one column, so no name of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), key_of().alias("mix_key"), hash_of().alias("mix_hash"))
    taken = _with_plan(rows, plan).withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), _copies().cast("int"))))
    return taken.select("given.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || md5(concat_ws(':', CAST(doc_id AS VARCHAR), text))[1:15])::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS i,
         sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         1.5 * sum(source_size) OVER () AS total FROM w
), l AS (
  SELECT arg_min((total - coalesce(below, 0)) / open_weight, i) AS level FROM o WHERE (total - coalesce(below, 0)) / open_weight <= 2 * source_size / weight
), t AS (
  SELECT source, source_size, least(2 * source_size, weight * level) AS target FROM w, l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t
), c AS (
  SELECT d.doc_id, d.size, d.h, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (copies + CASE WHEN upto <= rest OR (upto - same <= rest AND upto - rest < rest - (upto - same)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
