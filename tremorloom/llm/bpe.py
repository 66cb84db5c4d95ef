"""Byte-level BPE: recursive queries per partition encode, ordered aggregation decodes.

Each task splits its texts into pretokens and gives the distinct ones it has not met lately to an in-process DuckDB. There
token-position rows join the merge table, and a recursive query contracts each word's leftmost minimum-rank pair until no
pair is left. Decoding joins token-position rows with the vocabulary and aggregates the bytes in order. Documents never
leave their partition, so nothing is shuffled; the only shared data is the vocabulary file, whose path is a parameter.

A word of more than LONG bytes, such as a blob of letters, would be copied whole in each round of the query. It contracts the
same pairs in the same order from a heap instead, and is decoded like the others.

Null and empty texts have no tokens. Repeated rows stay repeated and agree. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorloom.llm.common import trim

#: Bytes of pretokens and ids kept in each of two generations of a task's memo; the older one goes when the younger is full.
MEMO_BYTES = 48_000_000
#: Words, and bytes of words, that one recursive query takes, and the memory that it may use.
WORDS_PER_QUERY, BYTES_PER_QUERY = 64_000, 600_000
MEMORY = "256MB"
#: Bytes of a word above which it is contracted from a heap.
LONG = 512
_NONE = 99_999_999

_ENCODE = f"""
WITH RECURSIVE bytes_at AS (
  SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS following FROM positions
), state(w, tokens, pair_ranks) AS (
  SELECT b.w, list(b.t ORDER BY b.p), list(coalesce(m.rank, {_NONE}) ORDER BY b.p)
  FROM bytes_at b LEFT JOIN merges m ON m.pair = b.t * 65536 + b.following GROUP BY b.w
  UNION ALL
  SELECT s.w,
         s.tokens[:s.i - 1] || [s.rank] || s.tokens[s.i + 2:],
         CASE WHEN s.i > 1 THEN s.pair_ranks[:s.i - 2] || [coalesce(l.rank, {_NONE})] ELSE []::BIGINT[] END
           || [coalesce(r.rank, {_NONE})] || s.pair_ranks[s.i + 2:]
  FROM (SELECT *, tokens[i - 1] * 65536 + rank AS left_pair, rank * 65536 + tokens[i + 2] AS right_pair
        FROM (SELECT *, list_position(pair_ranks, rank) AS i FROM (SELECT *, list_min(pair_ranks) AS rank FROM state) WHERE rank < {_NONE})) s
  LEFT JOIN merges l ON l.pair = s.left_pair LEFT JOIN merges r ON r.pair = s.right_pair
)
SELECT w, tokens FROM state WHERE list_min(pair_ranks) = {_NONE}
"""
_DECODE = """
SELECT e.w, array_to_string(e.tokens, ' ') AS ids, d.spelled
FROM encoded e JOIN (
  SELECT p.w, string_agg(v.spelled, '' ORDER BY p.p) AS spelled
  FROM (SELECT w, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS p FROM encoded) p JOIN vocabulary v ON v.id = p.t GROUP BY p.w
) d ON d.w = e.w
"""

#: The same matches as the public pattern for texts without the characters of _odd(), in the faster module.
_PLAIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@cache
def _odd() -> frozenset[str]:
    """Characters that the two regular-expression modules class differently or that the plain pattern can't tell apart."""
    import regex

    every = "".join(map(chr, (x for x in range(0x110000) if not 0xD800 <= x < 0xE000)))
    marks = set()
    for public, plain in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        marks |= set(regex.findall(public, every)) ^ set(re.findall(plain, every))
    return frozenset(marks)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one task, with a bounded memo of words."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.by_byte = [self.ranks[bytes([i])] for i in range(256)]
        self.slow, self.odd = regex.compile(pattern), _odd()
        self.plain = pattern == PATTERN
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        #: What words decode to, of those that do not decode to themselves.
        self.changed: dict[str, str] = {}
        self.held = 0
        pairs = [(self.ranks[t[:i]] * 65536 + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.register("merge_rows", pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int64())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.register("vocabulary_rows", pa.table({"id": pa.array(range(len(self.bytes_of)), pa.int64()), "spelled": [x.decode("latin-1") for x in self.bytes_of]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows")

    def pretokens(self, text: str) -> list[str]:
        if self.plain and (not _RARE.search(text) or self.odd.isdisjoint(text)):
            return _PLAIN.findall(text)
        return self.slow.findall(text)

    def _encode(self, words: list[bytes]) -> None:
        """Fill table encoded with the token ids of some words; a word that is a token itself is that token."""
        long = [(i, self._contracted(x)) for i, x in enumerate(words) if len(x) > LONG and x not in self.ranks]
        self.db.execute("CREATE OR REPLACE TABLE encoded (w BIGINT, tokens BIGINT[])")
        known = [(i, [self.ranks[x]]) for i, x in enumerate(words) if x in self.ranks] + long
        if known:
            self.db.register("known", pa.table({"w": pa.array([i for i, _ in known], pa.int64()), "tokens": pa.array([t for _, t in known], pa.list_(pa.int64()))}))
            self.db.execute("INSERT INTO encoded SELECT * FROM known")
        rest = [i for i, x in enumerate(words) if 0 < len(x) <= LONG and x not in self.ranks]
        if not rest:
            return
        lengths = np.array([len(words[i]) for i in rest])
        w = np.repeat(np.array(rest), lengths)
        p = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        t = np.array(self.by_byte, np.int64)[np.frombuffer(b"".join(words[i] for i in rest), np.uint8)]
        self.db.register("positions", pa.table({"w": w, "p": p, "t": t}))
        self.db.execute(f"INSERT INTO encoded {_ENCODE}")

    def _contracted(self, word: bytes) -> list[int]:
        """Token ids of a long word: the leftmost pair of least rank first, from a heap of pairs of which stale ones are passed over."""
        n = len(word)
        tokens: list[int | None] = [self.by_byte[b] for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def rank(i: int) -> int | None:
            return self.ranks.get(self.bytes_of[tokens[i]] + self.bytes_of[tokens[after[i]]]) if after[i] < n else None

        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if tokens[i] is None or rank(i) != r:
                continue
            j = after[i]
            tokens[i], tokens[j], after[i] = r, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heappush(heap, (new, k))
        return [t for t in tokens if t is not None]

    def close(self) -> None:
        self.db.close()
        self.young, self.old, self.changed = {}, {}, {}

    def _spell(self) -> Iterator[tuple[int, str, bytes]]:
        """Rows of encoded: number, ids in decimals, and the bytes that the ids give by ordered aggregation."""
        found = self.db.sql(_DECODE).to_arrow_table()
        for i, ids, spelled in zip(found["w"].to_pylist(), found["ids"].to_pylist(), found["spelled"].to_pylist(), strict=True):
            yield i, ids, spelled.encode("latin-1")

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of token sequences."""
        self.db.execute("CREATE OR REPLACE TABLE encoded (w BIGINT, tokens BIGINT[])")
        self.db.register("given", pa.table({"w": pa.array(range(len(ids)), pa.int64()), "tokens": pa.array(ids, pa.list_(pa.int64()))}))
        self.db.execute("INSERT INTO encoded SELECT * FROM given")
        out = [b""] * len(ids)
        for i, _, spelled in self._spell():
            out[i] = spelled
        return out

    def learn(self, words: set[str]) -> None:
        """Encode words and decode their ids again, in steps bounded in words and bytes, into the young generation."""
        part: list[str] = []
        raw: list[bytes] = []
        size = 0
        for x in words:
            coded = x.encode()
            if part and (len(part) == WORDS_PER_QUERY or size + len(coded) > BYTES_PER_QUERY):
                self._learn(part, raw)
                part, raw, size = [], [], 0
            part.append(x)
            raw.append(coded)
            size += len(coded)
        if part:
            self._learn(part, raw)

    def _learn(self, part: list[str], raw: list[bytes]) -> None:
        self._encode(raw)
        for i, ids, back in self._spell():
            self.young[part[i]] = ids
            if back != raw[i]:
                self.changed[part[i]] = back.decode("utf-8", "surrogateescape")
            self.held += len(ids) + 2 * len(back) + 250

    def documents(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, in decimals joined by spaces, and the bytes decoded from them."""
        split = [self.pretokens(x) for x in texts]
        young, old = self.young, self.old
        unknown = set()
        for x in set().union(*split):
            if x not in young:
                if x in old:
                    young[x] = old[x]
                    self.held += len(old[x]) + 2 * len(x) + 250
                else:
                    unknown.add(x)
        self.learn(unknown)
        for x in split:
            back = [self.changed.get(w, w) for w in x] if self.changed else x
            yield " ".join(map(young.__getitem__, x)), "".join(back).encode("utf-8", "surrogateescape")
        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = young, {}, 0
            self.changed = {w: back for w, back in self.changed.items() if w in young}


#: Texts without these go to the plain pattern at once: control separators, raised digits, fractions, other scripts.
_RARE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
#: Fixed value: the split that the vocabulary file belongs to.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@contextmanager
def codec(path: str, pattern: str = PATTERN) -> Iterator[Codec]:
    """The codec of one task. It goes with the task: what a reused Python worker kept would be missing to the next query."""
    mine = Codec(path, pattern)
    try:
        yield mine
    finally:
        mine.close()
        trim()


#: Characters of text that one step takes; a longer text is a step of its own.
STEP_CHARS = 2_000_000


def _steps(texts: list[str]) -> Iterator[list[str]]:
    step, size = [], 0
    for x in texts:
        if step and size + len(x) > STEP_CHARS:
            yield step
            step, size = [], 0
        step.append(x)
        size += len(x)
    if step:
        yield step


def with_tokens(df: DataFrame, path: str, text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """df with token_ids (array of int), n_tokens and decoded (the text that the ids give back); columns so named are replaced."""
    schema = df.withColumns({"token_ids": F.array(F.lit(0)), "n_tokens": F.lit(0).cast("long"), "decoded": F.lit("")}).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as mine:
            for batch in batches:
                at = 0
                for step in _steps(batch.column(text).fill_null("").to_pylist()):
                    part = batch.slice(at, len(step))
                    at += len(step)
                    rows = list(mine.documents(step))
                    ids = [[int(x) for x in a.split()] for a, _ in rows]
                    new = {"token_ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "decoded": pa.array([b.decode("utf-8", "replace") for _, b in rows])}
                    yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(n) for n in schema.names], schema.names)

    return df.mapInArrow(add, schema)


def token_digest(df: DataFrame, path: str, text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Per row: doc_id, n_tokens, and hashes of the ids and of the bytes decoded from them."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as mine:
            for batch in batches:
                rows = []
                for step in _steps(batch.column(text).fill_null("").to_pylist()):
                    for ids, back in mine.documents(step):
                        rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(fields)[1:], strict=True))], schema=fields)

    return df.select("doc_id", F.col(text)).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_tokens(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """df with decoded_bytes, the bytes that each row's ids give by ordered aggregation; null ids give no bytes."""
    schema = df.withColumns({"decoded_bytes": F.lit(b"")}).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path) as mine:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    new = pa.array(mine.decode([x or [] for x in part.column(ids).to_pylist()]), pa.binary())
                    yield pa.RecordBatch.from_arrays([new if n == "decoded_bytes" else part.column(n) for n in schema.names], schema.names)

    return df.mapInArrow(add, schema)
