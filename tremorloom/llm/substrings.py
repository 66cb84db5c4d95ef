"""Substring dedup by seed and extend: passages of WINDOW words or more that a document with a smaller id also has.

Winnowing chooses, for every window of WINDOW words, the least-hash run of SEED words in it; consecutive windows mostly choose
the same run, which is then one anchor for a stretch of text. Two documents that share a window share its anchor at the same
place, so joining on anchors finds every repeat. An anchor that one document alone has ends there. The others are extended
both ways: first as a whole, by the hash of all words that their windows span; documents that agree in the whole stretch are
settled with the least id. Only the first document of each different stretch is extended window by window against the other
stretches of its anchor, so a group of copies costs its size and not its pairs. What is found is joined to maximal spans.

Windows are judged on the input. Ids decide: rows with equal doc_id do not repeat each other, a null doc_id counts as larger
than any other. Null, empty and short texts have no window and stay whole. Repeats within one document stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tremorloom.llm.common import cut, mixed, partitions, run_hashes, text_steps, words

WINDOW = 50
SEED = 20
_LAST = (1 << 63) - 1
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)


def _spans_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start to end, for many spans, from prefix sums."""
    with np.errstate(over="ignore"):
        n = len(h) + 1
        one = np.ones(1, np.uint64)
        power = np.cumprod(np.concatenate((one, np.full(n - 1, _B, np.uint64))))
        inverse = np.cumprod(np.concatenate((one, np.full(n - 1, _B_INVERSE, np.uint64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)))
        return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_B))


def anchors_of(h: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the whole stretch, text number, first window and number of windows of every stretch."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    runs = run_hashes(h, seed)
    chosen = np.lib.stride_tricks.sliding_window_view(runs, window - seed + 1).argmin(axis=1)
    chosen += np.arange(len(chosen))
    text = np.searchsorted(first, np.arange(len(chosen)), "right") - 1
    inside = np.arange(len(chosen)) + window <= first[text + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    pick, owner = chosen[at], text[at]
    # windows in a row with equal anchors are one stretch, also where words repeat and the anchor moves
    value = runs[pick]
    heads = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))))
    start = at[heads]
    count = np.diff(np.append(heads, len(at)))
    place = pick[heads]
    with np.errstate(over="ignore"):
        stretch = mixed(_spans_hash(h, start, start + count - 1 + window) + (place - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner = owner[heads]
    return runs[place], stretch, owner, start - first[owner], count


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("row_hash"), "text")


def anchor_table(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(anchor, stretch, doc, row_hash, start, windows) of every stretch of every text."""
    fields = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("doc", pa.int64()), ("row_hash", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row_hash = (np.asarray(batch.column(n)) for n in ("doc", "row_hash"))
            for at, _, data, offsets in text_steps(batch.column("text")):
                w = words(data, offsets)
                anchor, stretch, owner, start, count = anchors_of(w.hashes, w.first, window, seed)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(doc[at + owner]), pa.array(row_hash[at + owner]), pa.array(start, pa.int32()), pa.array(count, pa.int32())], schema=fields)

    return _keyed(docs).mapInArrow(run, "anchor long, stretch long, doc long, row_hash long, start int, windows int")


def _window_table(rows: DataFrame, window: int) -> DataFrame:
    """rows (doc, row_hash, text, stretches) -> (anchor, word_hash, doc, row_hash, start) of every window of the stretches."""
    fields = pa.schema([("anchor", pa.int64()), ("word_hash", pa.int64()), ("doc", pa.int64()), ("row_hash", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row_hash = (np.asarray(batch.column(n)) for n in ("doc", "row_hash"))
            lists = batch.column("stretches")
            bounds = np.asarray(lists.offsets)
            inner = lists.values
            anchor, start, count = (np.asarray(inner.field(n)) for n in ("anchor", "start", "windows"))
            for at, to, data, offsets in text_steps(batch.column("text")):
                w = words(data, offsets)
                if len(w.hashes) < window:
                    continue
                hashes = run_hashes(w.hashes, window)
                lo, hi = bounds[at], bounds[to]
                owner = np.repeat(np.arange(at, to), np.diff(bounds[at : to + 1]))
                n = count[lo:hi].astype(np.int64)
                item = np.repeat(np.arange(hi - lo), n)
                place = start[lo:hi].astype(np.int64)[item] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = owner[item]
                found = hashes[w.first[row - at] + place]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[lo:hi][item]), pa.array(found.view(np.int64)), pa.array(doc[row]), pa.array(row_hash[row]), pa.array(place, pa.int32())], schema=fields)

    return rows.mapInArrow(run, "anchor long, word_hash long, doc long, row_hash long, start int")


def repeat_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc, row_hash, spans): for each row with repeats the word spans [first, last) that windows of smaller ids cover."""
    spark = docs.sparkSession
    same = Window.partitionBy("anchor")
    anchors = anchor_table(docs, window, seed).repartition(partitions(spark), "anchor")
    seen = anchors.select("*", F.min("doc").over(same).alias("low"), F.max("doc").over(same).alias("high"), (F.min("stretch").over(same) != F.max("stretch").over(same)).alias("various"))
    shared = cut(seen.where("low < high").drop("low", "high"))
    owners = shared.groupBy("anchor", "stretch").agg(F.min("doc").alias("owner"))
    judged = shared.join(owners, ["anchor", "stretch"])
    whole = judged.where("owner < doc").select("doc", "row_hash", "start", (F.col("start") + F.col("windows") - 1 + window).alias("end"))

    leading = judged.where("owner = doc AND various").select("doc", "row_hash", F.struct("anchor", "start", "windows").alias("s"))
    perdoc = leading.groupBy("doc", "row_hash").agg(F.collect_list("s").alias("stretches"))
    windows = cut(_window_table(_keyed(docs).join(perdoc, ["doc", "row_hash"]), window))
    first = windows.groupBy("anchor", "word_hash").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").select("anchor", "word_hash", "owner")
    single = windows.join(first, ["anchor", "word_hash"]).where("owner < doc").select("doc", "row_hash", "start", (F.col("start") + window).alias("end"))
    found = whole.unionByName(single).select("doc", "row_hash", F.struct("start", "end").alias("span"))
    return found.groupBy("doc", "row_hash").agg(F.collect_set("span").alias("spans"))


def _mask(n: int, spans: list) -> np.ndarray:
    """True for the words that stay."""
    edge = np.zeros(n + 1, np.int64)
    if len(spans):
        np.add.at(edge, np.asarray(spans.field("start"), np.int64), 1)
        np.add.at(edge, np.asarray(spans.field("end"), np.int64), -1)
    return np.cumsum(edge)[:n] == 0


def _with_spans(docs: DataFrame, window: int, seed: int, *columns: str | Column) -> DataFrame:
    spans = repeat_spans(docs, window, seed).withColumnsRenamed({"doc": "doc_", "row_hash": "row_hash_", "spans": "spans_"})
    rows = docs.select(*columns, F.coalesce("doc_id", F.lit(_LAST)).alias("doc_"), F.xxhash64("text").alias("row_hash_"), F.col("text").alias("text_"))
    return rows.join(spans, ["doc_", "row_hash_"], "left")


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs with the repeated words taken out of text; a text that loses words is the rest joined by single spaces."""
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given")  # one column, so no name of it can clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text_"), batch.column("spans_"), strict=True):
                if spans.is_valid:
                    every = text.as_py().encode().split()
                    out.append(b" ".join(compress(every, _mask(len(every), spans.values))).decode())
                else:
                    out.append(text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(out, pa.string())], ["given", "kept"])

    rows = _with_spans(docs, window, seed, given)
    cleaned = rows.mapInArrow(run, StructType([rows.schema["given"], StructField("kept", StringType())]))
    return cleaned.select(*[F.col("kept").alias("text") if c == "text" else F.col("given").getField(c).alias(c) for c in docs.columns])


def removal_report(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest = [], [], []
            for text, spans in zip(batch.column("text_"), batch.column("spans_"), strict=True):
                every = (text.as_py() or "").encode().split()
                kept = list(compress(every, _mask(len(every), spans.values))) if spans.is_valid else every
                total.append(len(every))
                gone.append(len(every) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], schema=fields)

    return _with_spans(docs, window, seed, "doc_id").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
