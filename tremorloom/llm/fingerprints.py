"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph hashes to a wide vector: DENSE lanes modulo 2^64 from a cryptographic digest, SKETCH lanes modulo 2^32 with
the signed counts of its hashed word trigrams, and one lane that counts paragraphs modulo 2^32. A document's fingerprint is
the sum of its paragraphs' vectors, lane by lane. So the order of paragraphs does not matter, a paragraph is added or taken
away by adding or subtracting its vector, and equal texts have equal fingerprints. The cosine of the sketch lanes estimates
how alike two documents are. Written as hexadecimal lanes in that order.

Null and empty texts have the zero fingerprint, alike (1.0) to each other and unlike (0.0) anything else. Rows with a null
doc_id come last; rows with equal doc_id are ordered by the MD5 of their text, and repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorloom.llm.common import STEP_BYTES, partitions, text_steps, words

DENSE = 8
SKETCH = 256
GRAM = 3
_HEX = DENSE * 16 + SKETCH * 8 + 8
#: Lanes of the sketch and of the count are kept modulo this; texts of 2^31 equal trigrams would be needed to wrap one.
_MASK = (1 << 32) - 1
#: Ranges of doc_id for each shuffle partition, and most of them in all.
RANGES, MOST_RANGES = 8, 4096


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense lanes, sketch lanes and paragraph counts of each text."""
    n = len(texts)
    dense, sketch, count = np.zeros((n, DENSE), np.uint64), np.zeros((n, SKETCH), np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        paragraphs = [p for p in text.encode().split(b"\n") if p]
        count[i] = len(paragraphs)
        if paragraphs:
            digests = b"".join([hashlib.blake2b(p, digest_size=DENSE * 8).digest() for p in paragraphs])
            dense[i] = np.frombuffer(digests, "<u8").reshape(-1, DENSE).sum(axis=0, dtype=np.uint64)
    for at, to, data, offsets in text_steps(pa.array(texts, pa.large_string())):
        breaks = np.flatnonzero(data == 10) + 1
        bounds = np.unique(np.concatenate((offsets, breaks)))
        grams, first = words(data, bounds).grams(GRAM, short=True)
        owner = np.searchsorted(offsets, bounds[:-1], "right") - 1
        where = np.repeat(owner, np.diff(first)) * SKETCH + (grams & np.uint64(SKETCH - 1)).astype(np.int64)
        sign = np.where(grams >> np.uint64(63), 1.0, -1.0)
        sketch[at:to] = np.bincount(where, sign, (to - at) * SKETCH)[: (to - at) * SKETCH].reshape(-1, SKETCH).astype(np.int64)
    return dense, sketch & _MASK, count & _MASK


def written(dense: np.ndarray, sketch: np.ndarray, count: np.ndarray) -> list[str]:
    a, b, c = dense.astype(">u8"), sketch.astype(">u4"), count.astype(">u4")
    return [a[i].tobytes().hex() + b[i].tobytes().hex() + c[i : i + 1].tobytes().hex() for i in range(len(a))]


def read(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(-1, _HEX // 2)
    dense = np.ascontiguousarray(raw[:, : DENSE * 8]).view(">u8").astype(np.uint64)
    sketch = np.ascontiguousarray(raw[:, DENSE * 8 : DENSE * 8 + SKETCH * 4]).view(">u4").astype(np.int64)
    return dense, sketch, np.ascontiguousarray(raw[:, -4:]).view(">u4").astype(np.int64)[:, 0]


def combined(left: list[str], right: list[str], sign: int = 1) -> list[str]:
    """Fingerprints of left's paragraphs with right's added (sign 1) or taken away (sign -1)."""
    (a, b, c), (x, y, z) = read(left), read(right)
    with np.errstate(over="ignore"):
        return written(a + x if sign > 0 else a - x, (b + sign * y) & _MASK, (c + sign * z) & _MASK)


def likeness(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
    """0 to 1, row by row: 1 for equal fingerprints, else the cosine of the centred sketches, not below 0."""
    a, b = (np.where(s[1] >= 1 << 31, s[1] - (1 << 32), s[1]).astype(np.float64) for s in (left, right))
    norms = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    cosine = np.divide((a * b).sum(axis=1), norms, out=np.zeros(len(a)), where=norms > 0)
    same = (left[0] == right[0]).all(axis=1) & (left[1] == right[1]).all(axis=1) & (left[2] == right[2])
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """df with column fingerprint; a column so named is replaced."""

    @F.pandas_udf("string")
    def fingerprint(column: pd.Series) -> pd.Series:
        return pd.Series(written(*vectors(column.fillna("").tolist())))

    return df.withColumn("fingerprint", fingerprint(F.col(text)))


def with_change(df: DataFrame, fingerprint: str, paragraphs: str, out: str, sign: int = 1) -> DataFrame:
    """df with column out: fingerprint with the paragraphs of another text inserted (sign 1) or deleted (sign -1)."""

    @F.pandas_udf("string")
    def change(old: pd.Series, column: pd.Series) -> pd.Series:
        return pd.Series(combined(old.tolist(), written(*vectors(column.fillna("").tolist())), sign))

    return df.withColumn(out, change(F.col(fingerprint), F.col(paragraphs)))


def _ranges(docs: DataFrame) -> list[int]:
    """Bounds of doc_id ranges from approximate quantiles."""
    spark = docs.sparkSession
    n = min(RANGES * partitions(spark), MOST_RANGES)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    return sorted(set(cuts))


def beside_next(docs: DataFrame) -> DataFrame:
    """(place, halo, doc_id, tie, text): rows dealt by doc_id range, each range with a copy of the row that follows its last.

    One shuffle of the texts. The bounds and each range's first row number at most MOST_RANGES entries on the driver.
    Rows without doc_id are dealt by the first byte of their MD5.
    """
    bounds = _ranges(docs)
    keyed = docs.select("doc_id", "text", F.coalesce("text", F.lit("")).alias("body")).select("doc_id", F.md5("body").alias("tie"), "body")

    def own(doc_id: pd.Series, tie: pd.Series) -> np.ndarray:
        known = doc_id.notna().to_numpy()
        place = np.full(len(doc_id), len(bounds) + 1, np.int64)
        if known.any():
            place[known] = np.searchsorted(np.array(bounds, np.int64), doc_id[known].to_numpy(np.int64), "right")
        if not known.all():
            place[~known] += tie[~known].map(lambda x: int(x[:2], 16)).to_numpy(np.int64)
        return place

    @F.pandas_udf("long")
    def place(doc_id: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(own(doc_id.astype("Int64"), tie))

    heads = keyed.select("doc_id", "tie", place("doc_id", "tie").alias("place")).groupBy("place").agg(F.min(F.struct(F.col("doc_id"), F.col("tie"))).alias("h"))
    firsts = sorted((r["place"], r["h"]["doc_id"], r["h"]["tie"]) for r in heads.collect())  # a row a range
    before = {(d, t): firsts[i - 1][0] for i, (_, d, t) in enumerate(firsts)}

    @F.pandas_udf("array<long>")
    def places(doc_id: pd.Series, tie: pd.Series) -> pd.Series:
        ids = doc_id.astype("Int64")
        keys = zip((None if pd.isna(x) else int(x) for x in ids), tie, strict=True)
        return pd.Series([[p] if (q := before.get(k)) is None else [p, -1 - q] for p, k in zip(own(ids, tie), keys, strict=True)])

    dealt = keyed.withColumn("to", F.explode(places("doc_id", "tie")))
    rows = dealt.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("place"), (F.col("to") < 0).alias("halo"), "doc_id", "tie", "body")
    return rows.repartition(partitions(docs.sparkSession), "place").sortWithinPartitions("place", "halo", F.col("doc_id").asc_nulls_last(), "tie")


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _described(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """The result for texts[:-1], each beside the text after it."""
    edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(texts, texts[1:], strict=False)]
    plain, changed = vectors(texts), vectors(edited)
    own, after = tuple(v[:-1] for v in plain), tuple(v[1:] for v in plain)
    columns = [ids, [len(x) for x in texts[:-1]], [hashlib.sha256(x.encode()).hexdigest() for x in edited], written(*own), written(*changed), likeness(own, changed), likeness(own, after)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


def edit_report(docs: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, whose last half comes from the document that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        size, now, closed = 0, None, False
        for batch in batches:
            columns = zip(*(batch.column(n).to_pylist() for n in ("place", "halo", "doc_id", "body")), strict=True)
            for place, halo, doc_id, body in columns:
                if place != now:
                    ids, texts, size, now, closed = [], [], 0, place, False
                if closed:
                    continue
                texts.append(body)
                size += len(body)
                if not halo:
                    ids.append(doc_id)
                if halo or size > STEP_BYTES:
                    if len(texts) > 1:
                        yield _described(ids[: len(texts) - 1], texts)
                    ids, texts, size, closed = ids[len(texts) - 1 :], texts[-1:], len(body), halo
            del columns

    return beside_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
