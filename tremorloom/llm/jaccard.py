"""N-gram Jaccard join by parity sketches.

A document's tokens are its distinct GRAM-word shingles. Every token flips one position of a wide bit sketch, so two
sketches differ in at most as many positions, and so in at most as many parts, as there are tokens in the symmetric
difference of the sets. For a Jaccard similarity of 0.8 that difference is at most a ninth of both sizes together. Sizes
are put in bands; the sketch of a band has enough parts that two similar documents must agree in a part that is not empty,
by the pigeonhole principle. A part is kept as the XOR digest of the positions that are set in it, and the digests are the
join keys. A document so sparse that too few of its parts have tokens emits its empty parts as well, so no pair is lost.

Documents with equal sets form a class that is joined once. Candidates of a key are compared by graph.bucket_links, which
needs no pairs of a whole bucket: what it has not linked it deals again by the positions of the widest sketch, in which every
token has its own. A comparison first takes the Hamming distance of two bit sketches, a lower bound of the symmetric
difference; only where that allows a link are the exact sets compared, read again from the texts. Large groups of comparisons
with one document are salted.

Texts that are null, empty or only spaces have an empty set and no links. Texts of fewer than GRAM words have one token.
Rows with the same doc_id are separate documents; equal rows are equal sets. doc_id may be null: such a row links, and its
component takes the least id that is not null. Other columns, whatever their names, are kept by deduplicated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, mixed, partitions, release, text_steps, words
from tremorloom.llm.graph import bucket_links, components, shared_buckets

GRAM = 5
#: Similarity as a fraction of integers: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
BAND_GROWTH = 1.5
#: Members that one salt of a group of comparisons holds.
GROUP_ROWS = 500


def token_sets(column: pa.Array, gram: int = GRAM) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For steps of rows: first row, last row, the rows' distinct tokens in ascending order, and their bounds."""
    for at, to, data, offsets in text_steps(column):
        tokens, first = words(data, offsets, lower=True).grams(gram, short=True)
        owner = np.repeat(np.arange(to - at), np.diff(first))
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[fresh], owner[fresh]
        yield at, to, tokens, np.searchsorted(owner, np.arange(to - at + 1))


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return sums[first[1:]] - sums[first[:-1]]


def class_of(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    with np.errstate(over="ignore"):
        a, b = _summed(mixed(tokens), first), _summed(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)), first)
        return mixed(a ^ mixed(b + np.diff(first).astype(np.uint64))).view(np.int64)


def bit_sketches(tokens: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: as many bits as the least power of two that is 64 and the size or more, each flipped by its tokens."""
    sizes = np.diff(first)
    width = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)))
    base = np.concatenate(([0], np.cumsum(width)))
    place = np.repeat(base[:-1], sizes) + (mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D)) & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[i:j] for i, j in zip(base[:-1] >> 3, base[1:] >> 3, strict=True)]


def hamming(x: bytes, y: bytes) -> int:
    """Hamming distance of two parity sketches; the wider is folded to the narrower, as its positions are taken modulo its width."""
    if len(x) < len(y):
        x, y = y, x
    wide, narrow = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    return int(np.bitwise_count(np.bitwise_xor.reduce(wide.reshape(-1, len(narrow)), axis=0) ^ narrow).sum())


class Bands:
    """Size bands: their last size, the largest difference of a similar pair whose smaller set is in the band, and their parts."""

    def __init__(self, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> None:
        self.t, self.u = numerator, denominator
        self.last: list[int] = []
        self.parts: list[int] = []
        self.apart: list[int] = []

    def upto(self, size: int) -> None:
        while not self.last or self.last[-1] < size:
            low = self.last[-1] + 1 if self.last else 1
            high = max(low, int(low * BAND_GROWTH))
            # n <= m u / t, and |A xor B| <= (m + n) (u - t) / (u + t)
            apart = (high + high * self.u // self.t) * (self.u - self.t) // (self.u + self.t)
            parts = apart + 1
            while apart and parts < low:
                empty = math.exp(-low / parts)
                if parts * (1 - empty) - 4 * math.sqrt(parts * empty * (1 - empty)) > apart + 1:
                    break
                parts += 1
            self.last.append(high)
            self.parts.append(parts)
            self.apart.append(apart)

    def keys(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Join keys of each set, the set that each belongs to, and its band with the number of keys that a similar set shares."""
        sizes = np.diff(first)
        self.upto(int(sizes.max(initial=1)))
        last = np.array(self.last)
        own = np.searchsorted(last, sizes)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for below in (0, 1):
            # as the larger set of a pair a document also joins the band below, if a similar set fits there
            band = own - below
            use = (sizes > 0) & (band >= 0)
            if below:
                use &= sizes * self.t <= last[np.maximum(band, 0)] * self.u
            for b in np.unique(band[use]):
                rows = np.flatnonzero(use & (band == b))
                n = sizes[rows]
                at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append(self._keys_in(int(b), rows, n, tokens[at]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _keys_in(self, band: int, rows: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, apart = self.parts[band], self.apart[band]
        spread = mixed(tokens ^ np.uint64(band * 2 + 1))
        slot = np.repeat(np.arange(len(rows)), n) * parts + ((spread >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, spread = slot[order], spread[order]
        heads = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        word, place = np.bitwise_xor.reduceat(mixed(spread), heads), slot[heads]
        full = np.bincount(place // parts, minlength=len(rows))
        if (sparse := np.flatnonzero(full <= apart)).size:
            every = (sparse[:, None] * parts + np.arange(parts)).ravel()
            empty = np.setdiff1d(every, place, assume_unique=True)
            place, word = np.concatenate((place, empty)), np.concatenate((word, np.zeros(len(empty), np.uint64)))
        with np.errstate(over="ignore"):
            key = mixed(word + mixed((place % parts).astype(np.uint64) + np.uint64((band + 1) << 32)))
        # at most `apart` of a set's full parts differ from a similar set's, so it shares the rest
        needed = np.maximum(full - apart, 1) + (band << 32)
        return key.view(np.int64), rows[place // parts], needed[place // parts]


def set_table(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc_id, row_hash, n_shingles, class, sketch) of every row; class is null for an empty set."""
    schema = "doc_id long, row_hash long, n_shingles long, class long, sketch binary"
    fields = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, tokens, first in token_sets(batch.column("text"), gram):
                n = np.diff(first)
                name = pa.array(class_of(tokens, first), pa.int64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at).cast(pa.int64()), batch.column("row_hash").slice(at, to - at), pa.array(n, pa.int64()), name, pa.array(bit_sketches(tokens, first), pa.binary())], schema=fields)

    return docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text").mapInArrow(run, schema)


def sketch_keys(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(key, id, needed) of every part of every set; id is the class of the set, needed holds its band and least shared keys."""
    fields = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("needed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            for _, _, tokens, first in token_sets(batch.column("text"), gram):
                key, row, needed = bands.keys(tokens, first)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(class_of(tokens, first)[row]), pa.array(needed)], schema=fields)

    return docs.select("text").mapInArrow(run, "key long, id long, needed long")


def candidates(keys: DataFrame, passes: int = 2) -> DataFrame:
    """(key, id) of the keys that sets share, without the sets that share fewer keys than any similar pair would.

    A passage that many texts have makes them share a few parts; the count rules them out before anything is compared.
    """
    members = shared_buckets(keys, "needed").distinct()
    for _ in range(passes):
        each = Window.partitionBy("id", "needed")
        enough = members.withColumn("n", F.count("*").over(each)).where(F.col("n") >= F.col("needed").bitwiseAND(F.lit((1 << 32) - 1)))
        members = shared_buckets(enough.select("key", "id", "needed"), "needed")
    return members.select("key", "id")


def _compare(rows: DataFrame, gram: int) -> DataFrame:
    """rows (a, salt, other, id, text), each group led by the row of a itself (other false) -> (a, b, s)."""
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, other, ids = (batch.column(n).to_pylist() for n in ("a", "other", "id"))
            for at, to, tokens, first in token_sets(batch.column("text"), gram):
                left, right, likeness = [], [], []
                for i in range(at, to):
                    mine = tokens[first[i - at] : first[i - at + 1]]
                    if not other[i]:
                        pivot, held = a[i], mine
                    elif a[i] == pivot:
                        common = np.count_nonzero(held[np.minimum(np.searchsorted(held, mine), len(held) - 1)] == mine)
                        left.append(pivot)
                        right.append(ids[i])
                        likeness.append(common / (len(held) + len(mine) - common))
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(likeness, pa.float64())], schema=fields)

    dealt = rows.repartition(partitions(rows.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "other")
    return dealt.mapInArrow(run, "a long, b long, s double")


def _within_reach(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, lo, near): the least distance that the sketches leave each pair, and whether the pair may be similar."""
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lo", pa.float64()), ("near", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
            apart = np.array([hamming(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.int64)
            # a symmetric difference of d leaves a Jaccard similarity of (sizes - d) / (sizes + d) at most
            near = DENOMINATOR * (sizes - apart) >= NUMERATOR * (sizes + apart)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(2.0 * apart / (sizes + apart)), pa.array(near)], schema=fields)

    side = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, lo double, near boolean")


def _tokens_of(texts: DataFrame, gram: int) -> DataFrame:
    """(id, n, token) of texts(id, text)."""
    fields = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for at, to, tokens, first in token_sets(batch.column("text"), gram):
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at:to], n)), pa.array(np.repeat(n, n)), pa.array(tokens.view(np.int64))], schema=fields)

    return texts.mapInArrow(run, "id long, n long, token long")


def links(docs: DataFrame, sets: DataFrame, gram: int = GRAM) -> DataFrame:
    """Links (a, b) between classes that connect what all pairs of the similarity join would connect."""
    spark = docs.sparkSession
    members = cut(candidates(sketch_keys(docs, gram)))
    release(spark)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    named = sets.join(members.select(F.col("id").alias("class")).distinct(), "class", "left_semi").groupBy("class").agg(F.min_by(F.struct("doc_id", "row_hash", "n_shingles", "sketch"), order).alias("r"))
    wanted = cut(named.select(F.col("class").alias("id"), F.col("r.doc_id").alias("rep"), F.col("r.row_hash").alias("hash"), F.col("r.n_shingles").alias("n"), F.col("r.sketch").alias("sketch")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    texts = cut(rows.join(wanted, (rows.doc_id.eqNullSafe(wanted.rep)) & (rows.row_hash == wanted.hash)).select("id", "text").dropDuplicates(["id"]))
    release(spark)

    def distance(pairs: DataFrame) -> DataFrame:
        reach = cut(_within_reach(pairs, wanted))
        near = reach.where("near").select("a", "b")
        counted = near.groupBy("a").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("salts"))
        salted = near.join(counted, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
        others = salted.select("a", "salt", F.lit(True).alias("other"), F.col("b").alias("id")).join(texts, "id")
        heads = counted.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("other"), F.col("a").alias("id")).join(texts, "id")
        exact = _compare(others.unionByName(heads), gram).select("a", "b", (1.0 - F.col("s")).alias("lo"))
        return exact.withColumn("hi", F.col("lo")).unionByName(reach.where("NOT near").select("a", "b", "lo", F.lit(1.0).alias("hi")))

    return bucket_links(members, distance, lambda ids: _tokens_of(texts.join(ids, "id", "left_semi"), gram), NUMERATOR / DENOMINATOR)


def _kept_rows(docs: DataFrame, gram: int) -> DataFrame:
    """Per row: doc_id, row_hash, n_shingles, class and, of its component, the row that stays: the least doc_id, null last."""
    sets = cut(set_table(docs, gram))
    roots = components(links(docs, sets, gram))
    release(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_hash")
    least = sets.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("low"))
    rooted = least.join(roots, F.col("class") == F.col("id"), "left").select("class", "low", F.coalesce("root", "class").alias("root"))
    group = rooted.groupBy("root").agg(F.min("low").alias("keeper"))
    named = cut(rooted.join(group, "root").select("class", "keeper"))
    return sets.join(named, "class", "left")


def jaccard_components(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, row_hash, n_shingles and component_id, the least doc_id that links reach."""
    return _kept_rows(docs, gram).select("doc_id", "row_hash", "n_shingles", F.coalesce("keeper.doc_id", "doc_id").alias("component_id"))


def component_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with its component's id, or without id if no row of it has one. Rows without shingles stay."""
    mine = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("row_hash") == F.col("keeper.row_hash"))
    found = _kept_rows(docs, GRAM).where("class IS NOT NULL").groupBy("doc_id", "row_hash").agg(F.bool_or(mine).alias("stays"), F.count("*").alias("copies"))
    decided = cut(found.where("NOT stays OR copies > 1"))
    release(docs.sparkSession)
    # the row is carried as one column, so no name of it can clash
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("row_hash"), F.struct(*docs.columns).alias("given"))
    here = lambda those: rows["doc_id"].eqNullSafe(those["doc_id"]) & (rows["row_hash"] == those["row_hash"])
    once = rows.join(decided, here(decided), "left_anti")
    repeated = decided.where("stays")
    # of rows with one id and one text, which may differ elsewhere, the same one whatever the order
    one = rows.join(repeated, here(repeated), "left_semi").groupBy("doc_id", "row_hash").agg(F.min("given").alias("given"))
    return once.select("given").unionByName(one.select("given")).select("given.*")
