"""Phrase collocations against brute force and SQL: languages, pieces, long texts cut to shards, ranges cut inside subtrees."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA
from tremorloom.llm import phrases

SF = "/root/testdata/sf0.01"


def corpus(seed=6, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "And", "a", "é", "data", "flow", "x\x01y", "\x00", "🙂", "new", "york", "City", "hall", "in", "b"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 80)):
            words += rng.choice([["new", "York", "city", "hall"], ["data", "flow"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
            words[-1] += rng.choice(["", "", "", "", "", ".", ",", "\n", "?!", "\t", "  ", "\x0b"])
        rows.append((i, " ".join(words), rng.choice(["en", "en", "de", None, "zz"]), "s", 0))
    rows += [(500, None, "en", "s", 0), (501, "", None, "s", 0), (502, " .,\n", "fr", "s", 0), (503, "The The the THE " * 3000 + "end", "en", "s", 0), (504, "word" * 900 + " of the data flow" * 40, "de", "s", 0)]
    return rows + rows[:5]


def counts(rows):
    out = {}
    for _, text, lang, *_ in rows:
        f = out.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(w)):
                for m in range(1, 5):
                    if i + m <= len(w):
                        f[tuple(w[i : i + m])] += 1
    return out


def want(rows, least, top):
    out = []
    for lang, f in counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        c = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in c.items():
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in c.items()):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "range_bytes"), [(6 << 20, 4 << 20), (700, 900)])
def test_equals_brute_force(spark, shard, range_bytes):
    """The second case cuts texts of one piece into many shards, and the walk of one word into many ranges."""
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"words": F.lit(1), "rank": F.lit("x"), "a": F.lit(2)}).repartition(3)
    got = phrases.collocations(docs, 10, 40, shard=shard, range_bytes=range_bytes).collect()
    assert sorted(tuple(r) for r in got) == want(rows, 10, 40)


def test_counts_are_exact(spark):
    rows = corpus(8)
    got = phrases.phrase_counts(spark.createDataFrame(rows, SCHEMA).repartition(4), 1, shard=500, range_bytes=2000).collect()
    assert {(r["lang"], tuple(r["words"])): r["a"] for r in got} == {(lang, p): a for lang, f in counts(rows).items() for p, a in f.items()}
    assert len(got) == len({(r["lang"], tuple(r["words"])) for r in got})


def test_pieces_round_trip_and_merge():
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice(["a", "b", "cc", "d\x01"], 3000)).encode() + b". " + b"x " * 400
    data = np.frombuffer(text, np.uint8)
    t = phrases.Tokens(data, np.array([0, len(data)]), np.array([0]))
    trie = phrases.count_trie(t, np.arange(len(t.words)), [b"en"])
    bounds = [(b"en", b"a", b"b", b"cc", b"a"), (b"en", b"b"), (b"en", b"b", b"b", b"zz"), (b"zz", b"a")]
    pieces = [phrases.deserialised(piece) for _, piece in phrases.pieces_of(trie, bounds)]
    doubled = phrases.merged([phrases.deserialised(phrases.serialised(trie, np.arange(len(trie.depth)))), trie])
    assert (doubled.depth == trie.depth).all() and (doubled.count == 2 * trie.count).all() and doubled.vocabulary.equals(trie.vocabulary)
    assert sum(len(p.depth) for p in pieces) >= len(trie.depth) and all(p.depth[0] == 0 for p in pieces if len(p.depth))
    assert trie.count.max() == 3400 and (trie.count[trie.depth == 0] == [3400]).all()


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    db = duckdb.connect()
    path = f"{SF}/documents.parquet"
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = phrases.collocations(spark.read.parquet(path)).toArrow()
    other = db.sql(phrases.ORACLE).select(",".join(got.column_names)).to_arrow_table()
    assert [str(f.type) for f in got.schema] == [str(f.type) for f in other.schema]
    assert got.num_rows > 200 and sorted(map(repr, got.to_pylist())) == sorted(map(repr, other.to_pylist()))
    assert pa.types.is_int64(got.schema.field("score").type)
