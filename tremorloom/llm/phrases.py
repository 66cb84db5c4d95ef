"""Phrase collocations by count tries: how often every run of up to DEPTH words occurs, and which runs hold together.

Each task counts its texts shard by shard in a trie of depth DEPTH under a root for each language, held as sorted arrays. Tries
are serialised in order and cut into prefix ranges, whose bounds come from evenly spaced sample phrases. A range's pieces from
all shards are merged in slices by order; nodes that occur often enough leave the merge with the counts along their walk from the
root, so left parts of a phrase need no join. A range that begins inside a subtree is sent that subtree's ancestors too. Suffix
links, from a phrase to the phrase without its first word, are equi-joins depth by depth and bring the counts of right parts.

A shard sends a node at most once, so a word, phrase or text that a third of all rows have costs one entry a shard. Ranges are
cut anywhere, inside a hot word's or phrase's subtree as well. Tasks hold a shard of SHARD bytes, the pieces of a range (some
RANGE_BYTES of text) and their merge, never a language or the table; a text of any length is counted in pieces of a shard.

Words are the runs `[^\\x20\\x09]+` of pieces that `[.,;:!?\\x0A-\\x0D]` bounds, A-Z lower-cased; phrases lie within a piece.
Null text has no words, null lang counts as `und`, repeated rows count as often as they stand, ties go by score, frequency and
phrase in byte order. An empty table gives no phrase. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, partitions, trim

DEPTH = 4
#: Least count of a candidate; longer phrases of this share of its count swallow it; phrases reported for each language.
LEAST, SWALLOWED, TOP = 30, 80, 2000
SCALE = 2_000_000
#: Bytes of text in a shard's trie and, on average, in a range; sample phrases for each range; salts of the two-step ranking.
SHARD, RANGE_BYTES, SAMPLES, SALTS = 4 << 20, 3 << 20, 12, 32
UNKNOWN = "und"

#: The bytes that end pieces, and those that end words within one.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"

_KIND = np.zeros(256, np.uint8)  # 0 within words, 1 between words, 2 between pieces
_KIND[list(_BLANKS)] = 1
_KIND[list(_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Path = tuple[bytes, ...]


# ---------------------------------------------------------------- tokens


class Tokens:
    """Words of a stretch of bytes: ids by the order of `vocabulary`, language ids, and how many words of the piece follow."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, lang: np.ndarray) -> None:
        """edges: offsets of texts laid end to end, the last being the length; lang: an id for each text."""
        kind = _KIND[data]
        inside = kind == 0
        starts_text = np.zeros(len(data) + 1, bool)
        starts_text[edges] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        self.starts = np.flatnonzero(inside & (~before | starts_text[:-1]))
        n = len(self.starts)
        # a piece begins at a text's border and after a separator of pieces
        piece = np.cumsum((kind == 2) | starts_text[:-1], dtype=np.int32)[self.starts] if n else np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(inside, dtype=np.int32)))
        lengths = np.diff(np.append(ends[self.starts], ends[-1])) if n else np.zeros(0, np.int32)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        values = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))])
        coded = values.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.vocabulary = coded.dictionary.take(order)
        rank = np.empty(len(order), np.int64)
        rank[np.asarray(order)] = np.arange(len(order))
        self.words = rank[np.asarray(coded.indices)] if n else np.zeros(0, np.int64)
        self.lang = lang[np.searchsorted(edges, self.starts, "right") - 1] if n else np.zeros(0, np.int64)
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if n else np.zeros(0, np.int64)
        self.room = last[np.searchsorted(last, np.arange(n))] - np.arange(n) if n else np.zeros(0, np.int64)


def stretches(column: pa.Array, langs: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, edges of texts, their languages, bytes whose words are counted) in stretches of about `size` bytes.

    A stretch ends with a text or, within a longer one, where a word does; the next then begins DEPTH - 1 words earlier, and
    words from there on are counted by it.
    """
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1, at + 1)
        whole = data[offsets[at] : offsets[min(to, n)]]
        if len(whole) <= 2 * size:
            yield whole, offsets[at : min(to, n) + 1] - offsets[at], langs[at : min(to, n)], len(whole)
        else:  # one long text
            yield from _long(whole, langs[at : at + 1], size)
        at = min(to, n)


def _long(data: np.ndarray, lang: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    begin = 0
    while begin < len(data):
        end, starts = begin, []
        while end < len(data) and len(starts) <= DEPTH:  # enough words to go on from
            end = min(end + size, len(data))
            while end < len(data) and _KIND[data[end - 1]] == 0:  # to the end of a word
                gap = np.flatnonzero(_KIND[data[end : end + size]] != 0)
                end = min(end + (int(gap[0]) + 1 if len(gap) else size), len(data))
            inside = _KIND[data[begin:end]] == 0
            starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        counted = end - begin if end == len(data) else int(starts[1 - DEPTH])
        yield data[begin:end], np.array([0, end - begin]), lang, counted
        begin += counted


# ---------------------------------------------------------------- tries


class Trie:
    """Nodes in the order of their walks: depth (0 for a language's root), label and count. Labels are ids by byte order."""

    def __init__(self, depth: np.ndarray, label: np.ndarray, count: np.ndarray, langs: list[bytes], vocabulary: pa.Array) -> None:
        self.depth, self.label, self.count, self.langs, self.vocabulary = depth, label, count, langs, vocabulary
        self._ranks: dict[bytes, tuple[int, bool]] = {}

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """Nodes of each depth, in order."""
        return [np.flatnonzero(self.depth == d) for d in range(DEPTH + 1)]

    def rank(self, value: bytes, depth: int) -> tuple[int, bool]:
        """Place of a label among the trie's, and whether it is there."""
        if depth == 0:
            at = bisect.bisect_left(self.langs, value)
            return at, at < len(self.langs) and self.langs[at] == value
        if value not in self._ranks:
            at = bisect.bisect_left(range(len(self.vocabulary)), value, key=lambda i: self.vocabulary[i].as_py())
            self._ranks[value] = at, at < len(self.vocabulary) and self.vocabulary[at].as_py() == value
        return self._ranks[value]

    def find(self, path: Path) -> tuple[int, bool]:
        """Number of nodes before a path (language, words...), and whether the node there is the path's."""
        lo, hi = 0, len(self.depth)
        node = 0
        for d, value in enumerate(path):
            level = self.levels[d]  # children of a node are those of the next depth before its subtree ends
            first, last = np.searchsorted(level, (lo, hi))
            rank, known = self.rank(value, d)
            k = first + int(np.searchsorted(self.label[level[first:last]], rank))
            if k == last:
                return hi, False
            node = int(level[k])
            if not known or self.label[node] != rank:
                return node, False
            lo, hi = node + 1, int(level[k + 1]) if k + 1 < last else hi
        return node, True

    def walk(self) -> np.ndarray:
        """For each node, the index of its ancestor at each depth (itself at its own, -1 below)."""
        n = len(self.depth)
        out = np.full((n, DEPTH + 1), -1, np.int32)
        for d in range(DEPTH + 1):
            here = np.where(self.depth == d, np.arange(n, dtype=np.int32), np.int32(-1))
            out[:, d] = np.where(self.depth >= d, np.maximum.accumulate(here), -1) if n else here
        return out


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the rank of each key among them."""
    values, inverse = np.unique(keys, return_inverse=True)
    return values, inverse


def count_trie(t: Tokens, counted: np.ndarray, langs: list[bytes]) -> Trie:
    """The count trie of the runs that start at the words marked in `counted`; language ids are ranks in langs."""
    n, v = len(t.words), len(t.vocabulary) + 1
    at = np.arange(n)
    second = np.where(t.room >= 1, t.words[np.minimum(at + 1, n - 1)] + 1, 0) if n else at
    pairs, pair = _dense(t.words * v + second)
    third = np.where(t.room >= 2, pair[np.minimum(at + 2, n - 1)] + 1, 0) if n else at
    p = len(pairs) + 1
    if len(langs) * p * p >= 1 << 62:
        raise OverflowError("a shard has too many languages and words; use smaller shards")
    keys = np.sort((t.lang[counted] * p + pair[counted]) * p + third[counted])
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    keys, times = keys[heads], np.diff(np.append(heads, len(keys)))
    tail = keys % p
    head = keys // p % p
    lang = keys // p // p
    first, two = pairs[head] // v, pairs[head] % v
    three = np.where(tail > 0, pairs[np.maximum(tail - 1, 0)] // v + 1, 0)
    four = np.where(tail > 0, pairs[np.maximum(tail - 1, 0)] % v, 0)
    return _from_runs([lang, first, two - 1, three - 1, four - 1], times, langs, t.vocabulary)


def _from_runs(labels: list[np.ndarray], times: np.ndarray, langs: list[bytes], vocabulary: pa.Array) -> Trie:
    """The trie of distinct runs in order, -1 where a run has ended: a node wherever a run differs from the one before."""
    n = len(times)
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    depth, label, count, place = [], [], [], []
    for d, column in enumerate(labels):
        fresh = fresh | np.concatenate((fresh[:1], column[1:] != column[:-1]))
        heads = np.flatnonzero(fresh)
        sums = np.add.reduceat(times, heads) if len(heads) else times[:0]
        real = column[heads] >= 0
        heads, sums = heads[real], sums[real]
        depth.append(np.full(len(heads), d, np.uint8))
        label.append(column[heads].astype(np.int32))
        count.append(sums.astype(np.int32))  # a shard has fewer words
        place.append((heads * (DEPTH + 1) + d).astype(np.int32))
    order = np.argsort(np.concatenate(place), kind="stable")
    return Trie(*(np.concatenate(x)[order] for x in (depth, label, count)), langs, vocabulary)


# ---------------------------------------------------------------- serialised pieces


def _packed(values: pa.Array) -> bytes:
    """Strings as their number, lengths and bytes."""
    lengths = np.asarray(pc.binary_length(values)).astype(np.uint32)
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = memoryview(values.buffers()[2])[offsets[0] : offsets[-1]] if len(values) and values.buffers()[2] is not None else b""
    return struct.pack("<I", len(values)) + lengths.tobytes() + bytes(data)


def _unpacked(data: bytes, at: int) -> tuple[pa.Array, int]:
    (n,) = struct.unpack_from("<I", data, at)
    offsets = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint32, n, at + 4), dtype=np.int64)))
    at += 4 + 4 * n
    end = at + int(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[at:end])]), end


def serialised(trie: Trie, nodes: np.ndarray) -> bytes:
    """Nodes of a trie, in order, as bytes: the languages and words they use, then depths, labels and counts in a byte where that does."""
    depth, label, count = trie.depth[nodes], trie.label[nodes], trie.count[nodes]
    root = depth == 0
    langs, lang_ids = _dense(label[root])
    used, ids = _dense(label[~root])
    out = np.empty(len(nodes), np.uint32)
    out[root], out[~root] = lang_ids, ids
    width = 1 if len(used) < 1 << 8 else 2 if len(used) < 1 << 16 else 4
    small = np.minimum(count, 255).astype(np.uint8)
    large = count[count >= 255].astype(np.uint64)
    words = trie.vocabulary.take(pa.array(used))
    names = pa.array([trie.langs[i] for i in langs], pa.large_binary())
    columns = np.ascontiguousarray(out.view(np.uint8).reshape(-1, 4)[:, :width].T)
    return struct.pack("<IBI", len(nodes), width, len(large)) + depth.tobytes() + columns.tobytes() + small.tobytes() + large.tobytes() + _packed(names) + _packed(words)


def deserialised(piece: bytes) -> Trie:
    n, width, many = struct.unpack_from("<IBI", piece, 0)
    at = 9
    depth = np.frombuffer(piece, np.uint8, n, at)
    columns = np.zeros((4, n), np.uint8)
    columns[:width] = np.frombuffer(piece, np.uint8, n * width, at + n).reshape(width, n)
    label = np.ascontiguousarray(columns.T).view(np.int32)[:, 0]
    at += n * (1 + width)
    count = np.frombuffer(piece, np.uint8, n, at).astype(np.int64)
    count[count == 255] = np.frombuffer(piece, np.uint64, many, at + n).astype(np.int64)
    langs, at = _unpacked(piece, at + n + 8 * many)
    return Trie(depth, label, count, langs.to_pylist(), _unpacked(piece, at)[0])


def pieces_of(trie: Trie, bounds: list[Path]) -> Iterator[tuple[int, bytes]]:
    """(range, serialised nodes) of a trie: range i holds nodes from bounds[i - 1] on and before bounds[i].

    Ancestors of a range's first node that stand in earlier ranges come along, also where the shard has no node in the range:
    so every walk starts at a root, and ancestors' counts are those of all shards.
    """
    cuts = [0, *(trie.find(b)[0] for b in bounds), len(trie.depth)]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        above = [trie.find(bounds[i - 1][:d]) for d in range(1, len(bounds[i - 1]))] if i else []
        walk = [node for node, there in above if there and node < lo]
        if hi > lo or walk:
            yield i, serialised(trie, np.concatenate((np.array(walk, np.int64), np.arange(lo, hi))))


def merged(tries: list[Trie]) -> Trie:
    """The sum of tries that each are in order: labels to common ranks, walks packed to keys, equal keys added."""
    langs = sorted(set().union(*(t.langs for t in tries)))
    coded = pa.concat_arrays([t.vocabulary for t in tries]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    vocabulary = coded.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    place = {x: i for i, x in enumerate(langs)}
    bits = max(1, int(len(vocabulary) + 1).bit_length())
    if bits * 2 + len(langs).bit_length() > 62:
        raise OverflowError("a range has too many languages and words; use smaller ranges")
    # a node's key: language, first and second word; third and fourth; 0 where its walk has ended
    n = sum(len(t.depth) for t in tries)
    high, low, count, depth = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.uint8)
    at = 0
    for t, to in zip(tries, np.split(rank[np.asarray(coded.indices)] + 1, np.cumsum([len(t.vocabulary) for t in tries])[:-1]), strict=True):
        own = slice(at, at := at + len(t.depth))
        to_lang = np.array([place[x] for x in t.langs], np.int64)
        root = t.depth == 0
        label = np.empty(len(t.depth), np.int64)
        label[root], label[~root] = to_lang[t.label[root]], to[t.label[~root]]
        walk = t.walk()
        w = [np.where(walk[:, d] >= 0, label[walk[:, d]], 0) for d in range(DEPTH + 1)]
        high[own], low[own] = (w[0] << bits | w[1]) << bits | w[2], w[3] << bits | w[4]
        count[own], depth[own] = t.count, t.depth
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    heads = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))) if n else np.zeros(0, np.int64)
    count = np.add.reduceat(count[order], heads) if n else count
    high, low, depth = high[heads], low[heads], depth[order][heads]
    mask, label = (1 << bits) - 1, np.empty(len(heads), np.int32)
    for d, (half, shift) in enumerate(((high, 2 * bits), (high, bits), (high, 0), (low, bits), (low, 0))):
        here = depth == d
        label[here] = (half[here] >> shift & (mask if d else -1)) - (d > 0)
    return Trie(depth, label, count, langs, vocabulary)


# ---------------------------------------------------------------- Spark


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")


def _samples(rows: DataFrame, every: int) -> DataFrame:
    """The phrase that starts after every so many bytes of text, as (language, words...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = every // 2
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                size = text.as_buffer().size if text.is_valid else 0
                if carry < size:
                    data = np.frombuffer(text.as_buffer(), np.uint8)
                    while carry < size:
                        lo = carry
                        while lo > 0 and _KIND[data[lo - 1]] == 0:
                            lo -= 1
                        stretch = data[lo : lo + 1024]
                        gap = np.flatnonzero(_KIND[stretch] == 2)
                        words = bytes(_LOWER[stretch[: gap[0]] if len(gap) else stretch]).replace(b"\t", b" ").split(b" ")
                        words = [w for w in words if w][:DEPTH]
                        if words:
                            out.append([lang.as_py().encode(), *words])
                        carry += every
                carry -= size
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], ["path"])

    return rows.mapInArrow(run, "path array<binary>")


def range_bounds(rows: DataFrame, range_bytes: int = RANGE_BYTES) -> list[Path]:
    """Paths that cut all phrases into ranges of some range_bytes of text; SAMPLES phrases a range reach the driver."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes), min(partitions(rows.sparkSession), total // (64 << 10)))
    found = sorted({tuple(bytes(x) for x in r["path"]) for r in _samples(rows, max(1, total // (ranges * SAMPLES))).collect()})
    picks = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    return sorted(set(picks))


def shard_pieces(rows: DataFrame, bounds: list[Path], shard: int = SHARD) -> DataFrame:
    """(range, piece): every shard's trie, serialised by prefix range."""
    cuts = rows.sparkSession.sparkContext.broadcast(bounds)  # SAMPLES / RANGE_BYTES of the text bound its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, edges, lang, upto, langs in gathered(batches):
            t = Tokens(data, edges, lang)
            counted = _counted(t.starts, edges, upto)
            out = list(pieces_of(count_trie(t, counted, langs), cuts.value))
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out[at : at + 64]], pa.int32()), pa.array([x[1] for x in out[at : at + 64]], pa.binary())], ["range", "piece"])
            del t, out
        trim()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """Stretches laid end to end until they fill a shard."""
        held, size = [], 0
        for batch in batches:
            column = batch.column("lang").dictionary_encode()
            names = [x.encode() for x in column.dictionary.to_pylist()]
            for part in stretches(batch.column("text"), np.asarray(column.indices).astype(np.int64), shard):
                held.append((*part, names))
                size += len(part[0])
                if size >= shard:
                    yield _joined(held)
                    held, size = [], 0
        if held:
            yield _joined(held)

    return rows.mapInArrow(run, "range int, piece binary")


def _joined(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    langs = sorted(set().union(*(names for *_, names in held)))
    place = {x: i for i, x in enumerate(langs)}
    data, edges, lang, upto, base = [], [np.zeros(1, np.int64)], [], [], 0
    for part, own, ids, counted, names in held:
        data.append(part)
        edges.append(own[1:] + base)
        lang.append(np.array([place[x] for x in names], np.int64)[ids])
        upto.append(np.full(len(ids), base + counted))
        base += len(part)
    return np.concatenate(data), np.concatenate(edges), np.concatenate(lang), np.concatenate(upto), langs


def _counted(starts: np.ndarray, edges: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Words that this stretch counts: those that start before its texts' limits."""
    return np.flatnonzero(starts < upto[np.searchsorted(edges, starts, "right") - 1]) if len(starts) else np.zeros(0, np.int64)


def phrase_counts(docs: DataFrame, least: int = LEAST, shard: int = SHARD, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, words, a, n, lefts) of every run of up to DEPTH words that occurs `least` times or more in its language.

    n counts the language's words, lefts the occurrences of the run's first word, first two words, and so on, without the whole.
    """
    spark = docs.sparkSession
    rows = _texts(docs)
    bounds = range_bounds(rows, range_bytes)
    firsts = spark.sparkContext.broadcast(bounds)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for at, piece in zip(batch.column("range").to_pylist(), batch.column("piece"), strict=True):
                if at != current and held:
                    yield frequent(merged(held), current)
                    held = []
                current = at
                held.append(deserialised(piece.as_py()))
                if len(held) > 1 and sum(len(t.depth) for t in held[1:]) > 4 * max(len(held[0].depth), 1 << 18):
                    held = [merged(held)]
        if held:
            yield frequent(merged(held), current)
            held = []
        trim()

    def frequent(trie: Trie, at: int) -> pa.RecordBatch:
        walk = trie.walk()
        keep = (trie.count >= least) & (trie.depth > 0)
        if at and len(firsts.value) >= at:  # ancestors sent along belong to earlier ranges
            keep[: trie.find(firsts.value[at - 1])[0]] = False
        nodes = np.flatnonzero(keep)
        langs = [trie.langs[i].decode() for i in trie.label[walk[nodes, 0]]]
        depth = trie.depth[nodes].astype(np.int64)
        used = np.arange(1, DEPTH + 1)[None, :] <= depth[:, None]
        words = trie.vocabulary.take(pa.array(trie.label[walk[nodes, 1:][used]])).cast(pa.large_string()).cast(pa.string())
        less = np.arange(1, DEPTH + 1)[None, :] < depth[:, None]
        lists = lambda flags, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(flags.sum(1)))), pa.int32()), values)
        lefts = pa.array(trie.count[walk[nodes, 1:][less]], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), lists(used, words), pa.array(trie.count[nodes], pa.int64()), pa.array(trie.count[walk[nodes, 0]], pa.int64()), lists(less, lefts)], ["lang", "words", "a", "n", "lefts"])

    pieces = shard_pieces(rows, bounds, shard).repartition(max(partitions(spark), len(bounds) + 1), "range").sortWithinPartitions("range")
    return pieces.mapInArrow(merge, "lang string, words array<string>, a long, n long, lefts array<long>")


def with_rights(nodes: DataFrame) -> DataFrame:
    """nodes (lang, words, a, ...) with rights: occurrences of the run without its first word, first two words, and so on.

    A run's suffix link is one word shorter and as frequent, so links are followed depth by depth.
    """
    linked = nodes.where(F.size("words") == 1).withColumn("rights", F.array().cast("array<long>"))
    out = [linked]
    for d in range(2, DEPTH + 1):
        links = linked.select("lang", F.col("words").alias("link"), F.concat(F.array("a"), "rights").alias("rights"))
        here = nodes.where(F.size("words") == d).withColumn("link", F.slice("words", 2, d - 1))
        linked = cut(here.join(links, ["lang", "link"]).drop("link"))
        out.append(linked)
    return reduce(DataFrame.unionByName, out[1:])


def scored(runs: DataFrame) -> DataFrame:
    """Runs of two words or more with the l, r and score of their lowest-scoring cut, of equal ones the earliest. Decimals are exact."""
    best = F.expr(
        f"""array_min(transform(arrays_zip(lefts, rights), (c, k) -> named_struct(
            'score', CAST({SCALE} AS DECIMAL(8, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(c.lefts AS DECIMAL(19, 0)) + CAST(c.rights AS DECIMAL(19, 0))),
            'k', k, 'l', c.lefts, 'r', c.rights)))"""
    )
    return runs.withColumn("best", best).select("*", "best.score", "best.l", "best.r").drop("best")


def without_swallowed(runs: DataFrame, share: int = SWALLOWED) -> DataFrame:
    """Runs that no longer run contains at `share` percent of their count or more.

    A longer run that contains one is at most as frequent as one a word longer does, which is among the runs too; so each run
    answers for its parts without the first and without the last word.
    """
    parts = runs.where(F.size("words") > 2).select("lang", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), F.col("a").alias("longer"))
    most = parts.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    exact = lambda c, x: F.col(c).cast("decimal(19,0)") * F.lit(x).cast("decimal(4,0)")
    return runs.join(most, ["lang", "words"], "left").where(F.col("longer").isNull() | (exact("longer", 100) < exact("a", share))).drop("longer")


def top_ranked(runs: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language with their rank from 1, in two steps, so that no task ranks a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return first.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **sizes: int) -> DataFrame:
    """Per language the best collocations: lang, rank, phrase, a, l, r, n, score."""
    runs = scored(with_rights(cut(phrase_counts(docs, least, **sizes))))
    kept = without_swallowed(cut(runs.select("lang", "words", "a", "l", "r", "n", "score")))
    return top_ranked(kept.withColumn("phrase", F.array_join("words", " ")), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), s AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), f AS (
  SELECT lang, phrase, m, count(*) AS f FROM (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m FROM (SELECT *, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS m FROM s)) GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, m, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 30
), k AS (
  SELECT c.*, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), b AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, array_to_string(w[i:i + q - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM c)) GROUP BY ALL
), x AS (
  SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM x JOIN n USING (lang) QUALIFY rank <= 2000
"""
