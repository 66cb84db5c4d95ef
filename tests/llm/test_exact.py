"""Exact dedup against brute force: nulls, empty and long texts, ties, repeated rows, clashing hashes and names."""

import hashlib
import os
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, corpus
from tremorloom.llm import exact

DATA = "/root/testdata/sf0.001"


def rows_with_copies():
    rng = random.Random(3)
    base = corpus()
    texts = [r[1] for r in base if r[1]]
    long = "".join(rng.choice("abé🙂\n ") for _ in range(5000))
    more = [long, long[:-1], long + " ", long[:2048], long[:2048], long[1024:3072], "a" * 4096, "a" * 4096, "a" * 4095, "a" * 1024, "é" * 1024]
    rows = [(1000 + i, t, "en", "x", 0) for i, t in enumerate([*texts[::3], *more, *more[:3], *["hot copy " * 300] * 40, None, "", " "])]
    return base + rows


def want(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for i, text, *_ in rows:
        ids = groups[text or ""]
        known = [x for x in ids if x is not None]
        out.append((i, max(known) if known else None, len(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "hashed"), [(1024, F.xxhash64), (7, F.xxhash64), (16, lambda b: F.pmod(F.xxhash64(b), F.lit(5)))])
def test_equals_brute_force(spark, block, hashed):
    """The last case has five hashes for all blocks, so that content decides everywhere."""
    rows = rows_with_copies()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = exact.copy_report(docs, block, hashed).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == want(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r[1] or "" for r in rows}) == len({r["text_sha256"] for r in kept}) == len({r["identity"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_without_copies_keeps_columns(spark):
    rows = rows_with_copies()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("mine"), "identity": F.lit(1), "doc": F.lit(2), "a.b": F.lit(3)}).repartition(3)
    kept = exact.without_copies(docs)
    assert kept.schema == docs.schema
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.copy_report(empty).count() == 0 and exact.without_copies(empty).count() == 0


def test_query_equals_sql(spark):
    db = duckdb.connect()
    path = f"{DATA}/documents.parquet"
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    names = ["doc_id", "group_size", "keep_id", "kept", "text_sha256"]
    got = exact.copy_report(spark.read.parquet(path)).select(names).toArrow()
    other = db.sql(exact.ORACLE).select(",".join(names)).to_arrow_table()
    assert [str(f.type) for f in got.schema] == [str(f.type) for f in other.schema]
    assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, other.to_pylist()))
