"""The conversation trie against brute force: rebuilt conversations, ties, nulls, repeated rows, long and shared ones, clashing names."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tremorloom.llm import trie

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed=4):
    rng = random.Random(seed)
    said = ["hello", "Hé 🙂", "", None, "tell me more", "a\nb"]
    rows = []
    for c in range(80):
        if c % 13 == 4:
            continue  # absent, some of them donors
        n = rng.choice([1, 2, 3, 5, 8, 12])
        for turn in range(n):
            rows.append((c, turn if rng.random() < 0.9 else None, ["user", "assistant", None][turn % 3 if rng.random() < 0.2 else turn % 2], rng.choice(said[:3] if turn < 3 else said)))
    rows += [(200, t, "user", "same") for t in range(40)] + [(201 + i, t, "user", "same") for i in range(30) for t in range(rng.choice([3, 25, 40]))]
    rows += [(7, 1, "user", "twice"), (7, 1, "user", "twice"), (-3, 0, "user", "below zero"), (None, 0, "user", "nobody"), (10**12, None, None, None)]
    rng.shuffle(rows)
    return rows


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [(r[3], r[4]) for r in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(c / 5) * 0 - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def nodes_of(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[x] for x in children[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    """With blocks of three turns, running sums cross many blocks."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie.running, "__defaults__", (block,))
    monkeypatch.setattr(trie, "PIECE", 4)
    rows = conversations()
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "item": F.lit(1), "owner": F.lit(2)}).repartition(5)
    assert rows_of(trie.trie_report(turns)) == nodes_of(rebuilt(ordered(rows)))


def test_unchanged_conversations_with_their_texts(spark):
    rows = conversations(9)
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))
    convs = ordered(rows)
    assert rows_of(got) == nodes_of(convs)
    for r in got.collect():
        assert (r["role"], r["text"]) == (convs[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None))


def test_turnless_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie_report(empty).count() == 0
    assert trie.trie_report(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 400) if c % 5}
    c = next(c for c, x in h.items() if x >= 2)
    rows = [(c, t, "user", "gone") for t in range(h[c])]
    assert rows_of(trie.trie_report(spark.createDataFrame(rows, SCHEMA))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query_equals_sql(spark):
    db = duckdb.connect()
    path = f"{DATA}/conversations.parquet"
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = trie.trie_report(spark.read.parquet(path)).select(COLUMNS).toArrow()
    other = db.sql(trie.ORACLE).select(",".join(COLUMNS)).to_arrow_table()
    assert [str(f.type) for f in got.schema] == [str(f.type) for f in other.schema]
    assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, other.to_pylist()))
