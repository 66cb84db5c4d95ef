"""Quality classifier: Naive Bayes features, a linear hinge loss fitted by dual coordinate descent.

A text's features are indicators of hashed n-grams: its words, its word pairs, and runs of one to three word shapes (case,
length, kind of last character, whether the word repeats the one before). Each indicator is scaled by the log ratio of its
smoothed counts in the two classes, counted over all labelled training rows; then a linear support vector machine is fitted
on at most SAMPLE labelled rows, chosen by hash (the documented bound), and its margin is calibrated by a logistic curve on
rows that the margin was not fitted on. Scoring maps over whole texts with some megabytes of weights.

Null and empty texts have no features and get the score of the bias. Rows whose labels disagree or are null teach nothing.
With fewer than two labelled rows of either class every score is 0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, mixed, run_hashes, text_steps, words

#: log2 of the number of hashed features, labelled rows that the hinge loss sees, smoothing, and the fit's parameters.
BITS = 18
SAMPLE = 6_000
ALPHA = 1.0
COST, EPOCHS = 0.1, 12
THRESHOLD = 0.7

_KIND = np.full(256, 3, np.uint8)  # 0 lower or beyond ASCII, 1 upper, 2 digit, 3 other
_KIND[97:123] = 0
_KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
#: Fixed value: the characters that end a word in plain prose.
_KIND_LAST = _KIND.copy()
_KIND_LAST[[ord(c) for c in ".,;:?'\""]] = 0


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A small code for each word."""
    upper = np.concatenate(([0], np.cumsum(_KIND[data] == 1)))
    other = np.concatenate(([0], np.cumsum(_KIND[data] == 3)))
    length = ends - starts
    capitals, signs = upper[ends] - upper[starts], other[ends] - other[starts]
    loud = (capitals * 2 > length) & (length > 2)
    again = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    size = np.searchsorted([2, 4, 8, 16, 32], length)
    code = _KIND[data[starts]].astype(np.int64)
    for value, base in ((_KIND_LAST[data[ends - 1]], 4), (loud, 2), (again, 2), (np.minimum(signs, 3), 4), (size, 6)):
        code = code * base + value
    return code


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For steps of rows: first row, last row, the rows' distinct features in ascending order, and their bounds."""
    for at, to, data, offsets in text_steps(column):
        w = words(data, offsets)
        n, kinds = len(w.hashes), [w.hashes]
        owner = np.repeat(np.arange(to - at), np.diff(w.first))
        if n:
            shape = mixed(shapes(data, w.starts, w.ends, w.hashes).astype(np.uint64) + np.uint64(1 << 40))
            kinds.append(shape)
            kinds += [run_hashes(x, k) for x, k in ((w.hashes, 2), (shape, 2), (shape, 3)) if n >= k]
        found, owners = [], []
        for i, x in enumerate(kinds):
            gap = n - len(x)
            own = owner[: len(x)]
            inside = own == owner[gap:] if gap else np.ones(len(x), bool)
            found.append((mixed(x[inside] + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(own[inside])
        keys = np.unique(np.concatenate(owners) << BITS | np.concatenate(found))
        yield at, to, keys & ((1 << BITS) - 1), np.searchsorted(keys >> BITS, np.arange(to - at + 1))


@dataclass
class Model:
    """Weights of the indicators, bias, and slope and offset of the logistic curve over the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[found])))
        return 1 / (1 + np.exp(-np.clip(self.slope * (sums[first[1:]] - sums[first[:-1]] + self.bias) + self.offset, -40, 40)))


def descend(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over the scaled indicators; weights come back over plain indicators."""
    w, b = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([1.0 + (ratio[x] ** 2).sum() for x in rows])
    order = np.arange(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        for i in order:
            x, y = rows[i], signs[i]
            gradient = y * ((w[x] * ratio[x]).sum() + b) - 1
            step = min(max(alpha[i] - gradient / norm[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[x] += step * y * ratio[x]
                b += step * y
    return w * ratio, b


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on a slightly penalised likelihood."""
    scale = max(float(np.abs(margin).mean()), 1e-9)
    x, p = margin / scale, np.array([1.0, 0.0])
    good, bad = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(p[0] * x + p[1], -40, 40)))
        g = np.array([((q - target) * x).sum() + 1e-3 * p[0], (q - target).sum() + 1e-3 * p[1]])
        v = q * (1 - q)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        p = p - step
        if np.abs(step).max() < 1e-9:
            break
    return max(p[0], 0.0) / scale, p[1]


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, text, label): labelled rows that may teach; doc_id groups whose labels disagree are left out."""
    single = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high").select("doc_id", F.col("low").cast("int").alias("label"))
    return docs.where(~held_out("doc_id")).select("doc_id", "text").join(single.hint("shuffle_hash"), "doc_id")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text, label). Counts cover all rows; the hinge loss sees those of least hash, at most about sample."""
    total = rows.count()
    share = min(1.0, sample / max(total, 1))
    chosen = (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).alias("chosen")
    fields = pa.schema([("label", pa.int32()), ("feature", pa.int32()), ("n", pa.int64()), ("found", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)  # the last entry counts rows
        for batch in batches:
            label, chosen = np.asarray(batch.column("label")), batch.column("chosen").to_pylist()
            for at, to, found, first in features(batch.column("text")):
                per_row = np.repeat(label[at:to], np.diff(first))
                for y in (0, 1):
                    counts[y, :-1] += np.bincount(found[per_row == y], minlength=1 << BITS)
                    counts[y, -1] += np.count_nonzero(label[at:to] == y)
                keep = [i for i in range(at, to) if chosen[i]]
                if keep:
                    lists = [found[first[i - at] : first[i - at + 1]] for i in keep]
                    k = len(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(label[keep], pa.int32()), pa.array([-1] * k, pa.int32()), pa.array([1] * k, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], schema=fields)
        y, f = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(f, pa.int32()), pa.array(counts[y, f], pa.int64()), pa.nulls(len(y), pa.list_(pa.int32()))], schema=fields)

    seen = cut(rows.select("label", chosen, "text").mapInArrow(run, "label int, feature int, n long, found array<int>"))
    # at most 2 * 2**BITS rows come back
    table = seen.where("feature >= 0").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, (1 << BITS) + 1))
    counts[np.asarray(table["label"]), np.asarray(table["feature"])] = np.asarray(table["n"])
    if counts[:, -1].min() < 2:
        return Model(np.zeros(1 << BITS), 0.0, 0.0, 0.0)
    smooth = ALPHA + counts[:, :-1]
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    ratio[counts[:, :-1].sum(axis=0) < 2] = 0.0  # met once: no evidence
    picked = seen.where("feature = -1").select("label", "found").toArrow()  # bounded by sample
    lists, label = picked["found"].to_pylist(), np.asarray(picked["label"])
    examples = [np.array(x, np.int64) for x in lists]
    order = sorted(range(len(examples)), key=lambda i: (label[i], len(examples[i]), lists[i]))
    examples, label = [examples[i] for i in order], label[order]
    sign = np.where(label == 1, 1.0, -1.0)
    if len(label) < 4 or len(set(label)) < 2:
        return Model(np.zeros(1 << BITS), 0.0, 0.0, 0.0)
    half = np.arange(len(examples)) % 2 == 0
    margin = np.zeros(len(examples))
    for side in (half, ~half):
        w, b = descend([examples[i] for i in np.flatnonzero(side)], sign[side], ratio)
        for i in np.flatnonzero(~side):
            margin[i] = w[examples[i]].sum() + b
    slope, offset = calibrate(margin, label)
    w, b = descend(examples, sign, ratio)
    return Model(w, b, slope, offset)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with column quality_score; a column so named is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        texts = pa.array(column, pa.large_string(), from_pandas=True)
        return pd.Series(np.concatenate([held.value.scores(found, first) for _, _, found, first in features(texts)]) if len(texts) else np.zeros(0))

    return docs.withColumn("quality_score", score(F.col(text)))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit(labelled(docs, labels))
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
