"""Exact dedup by deterministic block naming: equal texts, and no others, get one integer identity.

Texts are cut into blocks of BLOCK characters. Distinct blocks are sorted and named by their rank; then the names of adjacent
blocks are paired, distinct pairs are sorted and named in their turn, and so on until a text has a single name. A name stands
for one content alone, so identities cannot collide: blocks are sorted by a 64-bit hash, which deals them evenly, and then by
content wherever two blocks share a hash. Whether any do is found by counting the distinct blocks of each hash, over the text
itself. The text is moved once, for that; names, pairs and ranks are integers.

Copies cost little: equal blocks and pairs are combined before they are moved, and joins back to the rows are plain equi-joins
that adaptive execution splits where one key has many rows. A very long text is many blocks, spread like any others; the number
of rounds is the logarithm of the longest text's blocks.

Null text counts as empty; all empty texts are equal. Of equal texts the row with the largest doc_id stays; a null doc_id counts
as smaller than any other, and of repeated rows with that id exactly one stays. An empty table gives an empty result. Other
columns play no part; without_copies keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, partitions

#: Characters of a block.
BLOCK = 1024

_PART = 33  # monotonically_increasing_id has the partition above this bit, the place in the partition below


def blocks_of(text: Column, block: int = BLOCK) -> Column:
    """The blocks of a text as an array; an empty or null text is one empty block. One pass, whatever the length."""
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(F.length(text) > 0, found).otherwise(F.array(F.lit("")))


def ranked(keys: DataFrame, by: Sequence[str], base: int) -> tuple[DataFrame, int]:
    """Distinct keys with their rank in the order of `by`, from base + 1 on, as `name`; and the last rank.

    The driver learns the number of keys of each range, nothing else.
    """
    dealt = cut(keys.repartitionByRange(partitions(keys.sparkSession), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    counts = {r["part"]: r["n"] for r in dealt.groupBy(F.shiftright("at", _PART).alias("part")).agg(F.count("*").alias("n")).collect()}
    before = []
    for part in range(max(counts, default=-1) + 1):
        before.append(base)
        base += counts.get(part, 0)
    offset = F.array(*[F.lit(b).cast("long") for b in before or [base]])[F.shiftright("at", _PART).cast("int")]
    return dealt.withColumn("name", offset + F.col("at").bitwiseAND((1 << _PART) - 1) + 1).drop("at"), base


def _block_names(rows: DataFrame, block: int, hashed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, int]:
    """rows (row, doc_id, text) -> (row, doc_id, text_sha256) and (row, at, blocks, name) of every block; and the last name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = rows.select(F.explode(blocks_of(text, block)).alias("block")).withColumn("hash", hashed(F.col("block")))
    distinct = every.groupBy("hash", "block").agg(F.count("*").alias("copies"))
    hashes = cut(distinct.groupBy("hash").agg(F.count("*").alias("texts")))
    digest = F.sha2(text, 256).alias("text_sha256")
    if hashes.where("texts > 1").isEmpty():
        names, last = ranked(hashes.select("hash"), ["hash"], 0)
        slim = cut(rows.select("row", "doc_id", digest, F.transform(blocks_of(text, block), lambda b: hashed(b)).alias("hashes")))
        places = slim.select("row", F.size("hashes").alias("blocks"), F.posexplode("hashes").alias("at", "hash"))
        return slim.drop("hashes"), places.join(names, "hash").select("row", "at", "blocks", "name"), last
    # some hash has several contents: content decides among them
    clashing = hashes.where("texts > 1").select("hash")
    alone = hashes.where("texts = 1").select("hash", F.lit("").alias("content"))
    keys = distinct.join(clashing, "hash", "left_semi").select("hash", F.col("block").alias("content")).unionByName(alone)
    names, last = ranked(keys, ["hash", "content"], 0)
    slim = cut(rows.select("row", "doc_id", digest, blocks_of(text, block).alias("contents")))
    places = slim.select("row", F.size("contents").alias("blocks"), F.posexplode("contents").alias("at", "content")).withColumn("hash", hashed(F.col("content")))
    placed = places.join(hashes, "hash").withColumn("content", F.when(F.col("texts") > 1, F.col("content")).otherwise(""))
    return slim.drop("contents"), placed.join(names, ["hash", "content"]).select("row", "at", "blocks", "name"), last


def _identified(rows: DataFrame, block: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """rows (row, doc_id, text), row being unique -> (row, doc_id, text_sha256, identity)."""
    slim, named, last = _block_names(rows, block, hashed)
    places = cut(named)
    longest = places.agg(F.max("blocks")).first()[0] or 1
    done = [places.where("blocks = 1")]
    while longest > 1:
        longest = (longest + 1) // 2
        even = F.col("at").bitwiseAND(1) == 0
        pairs = cut(
            places.where("blocks > 1")
            .groupBy("row", F.shiftright("at", 1).alias("at"), F.shiftright(F.col("blocks") + 1, 1).alias("blocks"))
            .agg(F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0).cast("long")).alias("right"))
        )
        names, last = ranked(pairs.groupBy("left", "right").agg(F.count("*").alias("copies")).drop("copies"), ["left", "right"], last)
        places = cut(pairs.join(names, ["left", "right"]).select("row", "at", "blocks", "name"))
        done.append(places.where("blocks = 1"))
    identities = reduce(DataFrame.unionByName, [d.select("row", F.col("name").alias("identity")) for d in done])
    return slim.join(identities, "row")


def _judged(rows: DataFrame, block: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """rows (row, doc_id, text) -> (row, doc_id, identity, text_sha256, keep (doc_id, row), group_size)."""
    found = cut(_identified(rows, block, hashed))
    groups = found.groupBy("identity").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    return found.join(groups, "identity")


def copy_report(docs: DataFrame, block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Per row: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256, identity."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kept = (F.col("row") == F.col("keep.row")).alias("kept")
    return _judged(rows, block, hashed).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept, "text_sha256", "identity")


def without_copies(docs: DataFrame, block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    fixed = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    judged = _judged(fixed.select("row", "doc.doc_id", "doc.text"), block, hashed)
    return fixed.join(judged.where("row = keep.row").select("row"), "row", "left_semi").select("doc.*")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
