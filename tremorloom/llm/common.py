"""Helpers shared by the operators: checkpoints, Arrow batches, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes at a time; a single longer text is taken alone and whole.
STEP_BYTES = 1 << 19

#: The bytes that separate words, space and tab to carriage return.
_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(_SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Without one, a local session gets a folder of its own.

    Raises ValueError on a cluster that names none: a folder of one machine would lose what other executors write.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints that nothing refers to any more, so that disk holds one step's and not all.

    Spark removes them once the driver has collected its garbage, which it else does every half hour. A local session, as in
    tests, goes on without waiting for that.
    """
    if spark.sparkContext.master.startswith("local["):
        return
    for _ in range(2):  # what the first round frees holds more
        gc.collect()
        time.sleep(1.2)  # the gateway tells the JVM once a second which objects Python has let go of
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # the cleaner works beside the driver


def trim() -> None:
    """Give the memory that a task has freed back to the machine: its worker lives on and shares the executor with others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that spreads every input bit over the output."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1024), _BASE, np.uint64))))
    return _powers


def text_steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, last row, bytes, row offsets within the bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@dataclass
class Words:
    """Words of a run of texts: byte bounds, 64-bit hashes, and for each text the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1 entries

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each text's k-word runs and their bounds. short: a text of fewer words counts as one run."""
        h, first = self.hashes, self.first
        counts = np.diff(first)
        whole = run_hashes(h, k) if len(h) >= k else np.zeros(0, np.uint64)
        n = np.maximum(counts - k + 1, 0)
        at = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = whole[at]
        if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
            alone = np.array([mixed(np.array([combined(h[first[i] : first[i + 1]])], np.uint64))[0] for i in few], np.uint64)
            places = np.cumsum(n)[few]
            out = np.insert(out, places, alone)
            n[few] = 1
        return out, np.concatenate(([0], np.cumsum(n)))


def combined(h: np.ndarray) -> np.uint64:
    """Order-dependent hash of a short run of word hashes."""
    out = np.uint64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = out * _BASE + x
    return out


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries, by doubling: log k passes whatever k is."""
    with np.errstate(over="ignore"):
        power, size = h, 1  # power[i]: hash of size entries from i
        out, done = None, 0
        base = _BASE
        while True:
            if k & size:
                if out is None:
                    out, done = power, size
                else:
                    m = len(h) - (done + size) + 1
                    out, done = out[:m] * base + power[done : done + m], done + size
            if size * 2 > k:
                return mixed(out[: len(h) - k + 1] + np.uint64(k))
            m = len(h) - 2 * size + 1
            power = power[:m] * base + power[size : size + m]
            size *= 2
            base = base * base | np.uint64(1)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of texts laid end to end."""
    inside = _IS_WORD[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:n] | ~np.concatenate(([False], inside[:-1])))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1 if n else np.zeros(0, np.int64)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(data, starts, ends, np.zeros(0, np.uint64), first)
    shown = _LOWER[data] if lower else data
    lengths = ends - starts
    # place of each byte in its word; separators keep 0
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))[: n - starts[0]] if starts[0] == 0 else np.concatenate((np.zeros(starts[0], np.int64), np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))))
    place[~inside] = 0
    with np.errstate(over="ignore"):
        values = (shown.astype(np.uint64) + np.uint64(1)) * _powers_to(int(lengths.max()) + 1)[place]
        values[~inside] = 0
        sums = np.add.reduceat(values, starts)
        return Words(data, starts, ends, mixed(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first)


def strings(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return column.fill_null("").to_pylist()
