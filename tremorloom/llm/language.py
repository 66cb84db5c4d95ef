"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

Text: a multinomial model of hashed byte trigrams for every language, counted over all rows that declare one. The languages
are all declared ones of LEAST_ROWS rows or more, the MOST_LANGUAGES most declared if there are more; rows of the others train one
language more, OTHER, so no row is left out. Declared language: its likelihood comes from counts of (declared, best by text). Host: a prior smoothed hierarchically, host towards registered domain towards
address suffix towards all rows, from grouped counts of the best language by text. The posterior multiplies them.

A row with nothing but separators, or null, has no text evidence, counts for no language, and goes by the rest; without a declared language, address or
host that part is left out. With no declared language anywhere nothing can be told: language is null and the row is accepted.
A row is rejected where no language reaches MIN_POSTERIOR. Ties go to the language first by code. Repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, mixed, text_steps

BUCKET_BITS = 14
#: Rows that a language is declared by at least, languages of their own at most, and what the rest is called together.
LEAST_ROWS, MOST_LANGUAGES, OTHER = 3, 200, "other"
ALPHA = 0.5
#: Trigrams are not independent: a text's evidence is its mean log likelihood times at most this many.
MOST_EVIDENCE = 60.0
STRENGTH = 20.0
DECLARED_PSEUDO = 1.0
MIN_POSTERIOR = 0.5
#: Hosts up to which their priors are broadcast; beyond, the join is salted.
BROADCAST_HOSTS = 20_000
SALTS = 16


def code_of(column: Column) -> Column:
    """Lower-case primary subtag, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(column), "^([A-Za-z]+)", 1)), F.lit(""))


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>|&[A-Za-z#0-9]+;", " ")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id null, page_id, text, declared, host) of pages: markup language and address."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), visible(F.col("html")).alias("text"), code_of(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)).alias("declared"), host.alias("host")
    )


def document_evidence(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, page_id null, text, declared, host, more) of documents: the column lang declares, the source is the host."""
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text", code_of(F.col("lang")).alias("declared"), F.lower("source").alias("host"))


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of texts and the text that each is in; digits and signs count as one separator."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fold = _FOLD[data].astype(np.uint64)
    code = fold[:-2] << np.uint64(16) | fold[1:-1] << np.uint64(8) | fold[2:]
    owner = np.searchsorted(offsets, np.arange(len(code)), "right") - 1
    inside = (np.arange(len(code)) + 3 <= offsets[owner + 1]) & (code & np.uint64(0xFFFF) != np.uint64(0x2020)) & (code >> np.uint64(8) != np.uint64(0x2020)) & (code >> np.uint64(8) & np.uint64(0xFF) != np.uint64(0x20))
    return (mixed(code[inside]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owner[inside]


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def languages(rows: DataFrame) -> list[str]:
    """Declared languages by code, OTHER the last if some are too rare or too many to be of their own."""
    counts = rows.where("declared IS NOT NULL").groupBy("declared").count()
    common = counts.where(F.col("count") >= LEAST_ROWS).orderBy(F.col("count").desc(), "declared").limit(MOST_LANGUAGES)
    known = sorted(r["declared"] for r in common.collect() if r["declared"] != OTHER)
    rest = counts.where(~F.col("declared").isin(known)) if known else counts
    return known if rest.isEmpty() else [*known, OTHER]


def language_of(declared: Column, known: list[str]) -> Column:
    """The language that a declaration stands for, null without one."""
    return F.when(declared.isin(known), declared).when(declared.isNotNull(), OTHER)


def text_model(rows: DataFrame, known: list[str]) -> np.ndarray:
    """Log probabilities, languages by buckets, from counts over all rows that declare a language."""
    number = {x: i for i, x in enumerate(known)}
    fields = pa.schema([("language", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(known), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            which = np.array([number[x] for x in batch.column("declared").to_pylist()], np.int64)
            for at, to, data, offsets in text_steps(batch.column("text")):
                bucket, owner = _trigrams(data, offsets)
                counts += np.bincount(which[at + owner] << BUCKET_BITS | bucket, minlength=counts.size).reshape(counts.shape)
        a, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[a, b], pa.int64())], schema=fields)

    seen = rows.where("declared IS NOT NULL").select(language_of(F.col("declared"), known).alias("declared"), "text").mapInArrow(run, "language int, bucket int, n long")
    table = seen.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages * 2**BUCKET_BITS rows
    counts = np.full((len(known), 1 << BUCKET_BITS), ALPHA)
    counts[np.asarray(table["language"]), np.asarray(table["bucket"])] += np.asarray(table["n"])
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def with_text_evidence(rows: DataFrame, model: np.ndarray, keep: list[str]) -> DataFrame:
    """keep columns with evidence: a log likelihood per language, 0 where the text has none."""
    held = rows.sparkSession.sparkContext.broadcast(model.T.astype(np.float32).copy())
    schema = rows.select(*keep, F.array(F.lit(0.0)).alias("evidence")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for at, to, data, offsets in text_steps(batch.column("text")):
                bucket, owner = _trigrams(data, offsets)
                n = np.bincount(owner, minlength=to - at)
                sums = np.stack([np.bincount(owner, held.value[bucket, j], to - at) for j in range(len(model))], axis=1)
                parts.append(sums * (np.minimum(n, MOST_EVIDENCE) / np.maximum(n, 1))[:, None])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(list(np.concatenate(parts)) if parts else [], pa.list_(pa.float64()))], schema.names)

    return rows.select(*keep, "text").mapInArrow(run, schema)


def _best(column: str) -> Column:
    return (F.array_position(column, F.array_max(column)) - 1).cast("int")


def _log_prior(counts: DataFrame, keys: list[str], up: DataFrame | None, above: list[str], n: int) -> DataFrame:
    """Per key: probabilities p smoothed towards those of the level above."""
    each = counts.groupBy(*keys).agg(*[F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i in range(n)])
    if up is None:
        prior = F.array(*[F.lit(1.0 / n) for _ in range(n)])
        base = each.withColumn("prior", prior)
    else:
        base = each.join(up.withColumnRenamed("p", "prior"), above) if above else each.crossJoin(F.broadcast(up.withColumnRenamed("p", "prior")))  # one row
    c = F.array(*[F.col(f"c{i}") for i in range(n)])
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return base.select(*keys, F.zip_with(c, "prior", lambda x, q: (x + STRENGTH * q) / (total + STRENGTH)).alias("p"))


def identified(rows: DataFrame, ids: list[str]) -> DataFrame:
    """ids with language, posterior, accepted, from rows with ids, text, declared and host."""
    known = languages(rows)
    if not known:
        return rows.select(*ids, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(True).alias("accepted"))
    n = len(known)
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract("host", r"\.([^.]+)$", 1)
    slim = cut(with_text_evidence(rows, text_model(rows, known), [*ids, "declared", "host"]).withColumns({"host": F.coalesce("host", F.lit("")), "best": F.when(F.array_max("evidence") < 0, _best("evidence"))}))
    parts = slim.withColumns({"domain": domain, "suffix": suffix})
    counts = parts.groupBy("suffix", "domain", "host", "best").agg(F.count("*").alias("n"))
    counts = cut(counts)
    everything = _log_prior(counts.withColumn("one", F.lit(1)), ["one"], None, [], n).drop("one")
    by_suffix = _log_prior(counts, ["suffix"], everything, [], n)
    by_domain = _log_prior(counts, ["suffix", "domain"], by_suffix, ["suffix"], n)
    by_host = cut(_log_prior(counts, ["suffix", "domain", "host"], by_domain, ["suffix", "domain"], n).select("host", F.transform("p", lambda x: F.log(x)).alias("host_prior")))
    # likelihood of the declared language: at most n + 1 by n counts
    said = language_of(F.col("declared"), known)
    confusion = np.full((n, n + 1), DECLARED_PSEUDO)
    for r in slim.where("best IS NOT NULL").groupBy(said.alias("said"), "best").count().collect():
        if r["said"] is not None:
            confusion[r["best"], known.index(r["said"])] += r["count"]
        else:
            confusion[r["best"], n] += r["count"]
    stated = np.log(confusion / confusion.sum(axis=1, keepdims=True))
    spark = rows.sparkSession
    table = spark.createDataFrame([(x, [float(v) for v in stated[:, i]]) for i, x in enumerate(known)], "stated string, likelihood array<double>")  # a row a language
    slim = slim.withColumn("stated", said).join(F.broadcast(table), "stated", "left")
    likelihood = F.coalesce("likelihood", F.array_repeat(F.lit(0.0), n))
    if by_host.count() <= BROADCAST_HOSTS:
        joined = slim.join(F.broadcast(by_host), "host")
    else:
        salted = by_host.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = slim.withColumn("salt", F.pmod(F.xxhash64("evidence", *ids), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    fused = joined.withColumn("fused", F.zip_with(F.zip_with("evidence", "host_prior", lambda a, b: a + b), likelihood, lambda a, b: a + b))
    top = F.array_max("fused")
    spread = F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    named = F.element_at(F.array(*[F.lit(x) for x in known]), _best("fused") + 1)
    posterior = (F.lit(1.0) / spread).alias("posterior")
    return fused.select(*ids, named.alias("language"), posterior).withColumn("accepted", F.col("posterior") >= MIN_POSTERIOR)


def language_report(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id or page_id, declared, host, language, posterior and accepted of every document and every page."""
    rows = document_evidence(docs).unionByName(page_evidence(pages)).withColumns({"said": F.col("declared"), "at": F.col("host")})
    return identified(rows, ["doc_id", "page_id", "said", "at"]).withColumnsRenamed({"said": "declared", "at": "host"})


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, unchanged, whatever their columns are called. Equal rows are judged alike."""
    row = F.xxhash64("doc_id", "text", "lang", "source").alias("row")
    refused = identified(document_evidence(docs, row), ["row"]).where(~F.col("accepted")).select("row").distinct()
    # the row is carried as one column, so no name of it can clash
    return docs.select(row, F.struct(*docs.columns).alias("given")).join(refused, "row", "left_anti").select("given.*")
