"""A prefix trie of conversations: which turns many conversations share, and what storing them once would save.

A prefix of d turns is known by its depth and a digest, the running sum over the turns of four 32-bit hash lanes that see the
turn's place, role and text. A prefix belongs to the least conv_id that starts with it. The owner only grows with the depth, so
a conversation owns its last turns from some first depth on, its chain; that depth is found by binary search, one batched join
of the open conversations against the owners of shared prefixes a round. Above its chain's head stands the node that the last
failed probe met. Chains form a tree; what their subtrees hold is summed bottom-up by doubling (after k rounds a chain has
its descendants to distance 2^k), and running sums along each chain give every node its share.

Nothing gathers a conversation: order within one comes from a sort by range, running sums go by blocks of BLOCK turns and
their totals, and the id lists that are hashed are streamed in sorted pieces. A first turn that a third of all conversations share
is combined before it is moved.

Conversations are ordered by turn, null first; ties by the SHA-256 of role and text, so reruns agree. Null role or text counts
as empty. Rows without conv_id belong to no conversation. Repeated rows are turns in their own right. An empty table has no
conversation and so no node, not even the root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, partitions

#: Turns that one running sum takes; totals of such blocks join them.
BLOCK = 4096
#: Turns at the head of a conversation that the rebuild may take from another, plus one; conversations that share a donor.
HEADS, FAMILY = 9, 5
#: Ids of one piece of an id list.
PIECE = 512

_PART = 33
LANES = ["s0", "s1", "s2", "s3"]
KEY = ["depth", *LANES]


def turn_digest() -> Column:
    """SHA-256 of a turn's role and text; the length of the role keeps them apart."""
    role = F.coalesce(F.col("role"), F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.coalesce(F.col("text"), F.lit(""))), 256)


def running(rows: DataFrame, group: str, at: str, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """rows with each of `values` summed over the rows of the group up to and with this one; `at` counts within the group.

    No task sees a whole group: sums run within blocks of places, and the totals of earlier blocks are added.
    """
    blocks = rows.withColumn("block_", F.floor(F.col(at) / block).cast("long"))
    inner = Window.partitionBy(group, "block_").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(group, "block_").agg(*[F.sum(v).alias(v) for v in values])
    earlier = totals.select(group, "block_", *[F.sum(v).over(before).alias(f"{v}_") for v in values]).where("block_ > 0")
    summed = blocks.withColumns({v: F.sum(v).over(inner) for v in values}).join(earlier, [group, "block_"], "left")
    return summed.withColumns({v: F.col(v) + F.coalesce(f"{v}_", F.lit(0)) for v in values}).drop("block_", *[f"{v}_" for v in values])


def ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, item digest, bytes) of every turn, and (conv_id, length) of every conversation."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("item"), F.col("row")]  # the row, so that equal turns are dealt out too
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest().alias("item"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")
    )
    dealt = slim.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", _PART))
    spans = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that it spans
    offsets = spans.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    depth = (F.col("at") - F.col("first") + F.col("offset") + 1).alias("depth")
    return placed.join(offsets, ["conv_id", "part"]).select("conv_id", depth, "item", "bytes"), spans.groupBy("conv_id").agg(F.sum("n").alias("length"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations whose first h turns come from the first conversation of their family of FAMILY ids.

    h is the CRC-32 of the decimal conv_id modulo HEADS; a donor that is absent gives none, one that is shorter all it has.
    """
    items, convs = ordered(turns)
    items, convs = cut(items), cut(convs)
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    plan = convs.select("conv_id", "length", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("donor"))
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("length").alias("has"))
    plan = cut(plan.join(donors, "donor", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))))
    own = items.join(plan.select("conv_id", "h", "taken"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "item", "bytes")
    given = items.where(F.col("depth") < HEADS).withColumnRenamed("conv_id", "donor")
    lent = given.join(plan.where("taken > 0").select("conv_id", "donor", "taken"), "donor").where("depth <= taken").select("conv_id", "depth", "item", "bytes")
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    return own.unionByName(lent), lengths


def with_keys(items: DataFrame) -> DataFrame:
    """(conv_id, bytes, depth, lanes): the digest of the prefix that ends with each turn."""
    lane = lambda i: F.xxhash64(F.lit(i), "depth", "item").bitwiseAND(0xFFFFFFFF)
    return running(items.select("conv_id", "depth", "bytes", *[lane(i).alias(s) for i, s in enumerate(LANES)]), "conv_id", "depth", LANES)


def _first_owned(prefixes: DataFrame, convs: DataFrame, shared: DataFrame, root: int) -> DataFrame:
    """(conv_id, length, head, above): the first depth that a conversation owns, length + 1 if none, and the owner one depth above.

    The root's conversation has head 0 and no above. Each round halves every open range and drops the prefixes outside.
    """
    longest = convs.agg(F.max("length")).first()[0] or 0
    state = cut(convs.select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high"), F.lit(root).cast("long").alias("above")))
    left = prefixes.drop("bytes")
    for _ in range(longest.bit_length()):
        ranges = state.where("low < high").select("conv_id", "low", "high")
        left = cut(left.drop("low", "high").join(ranges, "conv_id").where("depth >= low AND depth < high"))
        probes = left.where("depth = (low + high) div 2").join(shared, KEY, "left").select("conv_id", F.col("depth").alias("at"), F.coalesce("owner", "conv_id").alias("met"))
        own = F.col("met") == F.col("conv_id")
        state = cut(
            state.join(probes, "conv_id", "left").select(
                "conv_id",
                "length",
                F.when(F.col("at").isNull() | own, F.col("low")).otherwise(F.col("at") + 1).alias("low"),
                F.when(own, F.col("at")).otherwise(F.col("high")).alias("high"),
                F.when(F.col("at").isNull() | own, F.col("above")).otherwise(F.col("met")).alias("above"),
            )
        )
    is_root = F.col("conv_id") == root
    return state.select("conv_id", "length", F.when(is_root, 0).otherwise(F.col("low")).alias("head"), F.when(~is_root, F.col("above")).alias("above"))


def _subtree_sums(chains: DataFrame) -> DataFrame:
    """chains (conv_id, above, values leaves and saved) -> (conv_id, leaves, saved) over the chain and all chains below it.

    Doubling: a round adds the sums of the chains 2^k below and doubles the reach, so rounds are the logarithm of the tree's height.
    """
    state = cut(chains)
    while not state.where("above IS NOT NULL").isEmpty():
        below = state.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        next_up = state.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        state = cut(
            state.join(below, "conv_id", "left")
            .join(next_up, "above", "left")
            .select("conv_id", F.col("next").alias("above"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        )
    return state.drop("above")


def id_list_digests(ends: DataFrame) -> DataFrame:
    """ends (conv_id, depth, id) -> (conv_id, depth, ends_sha256) of the decimal ids in ascending order, comma-joined.

    Lists are joined to pieces where the sort has put them; only pieces of a list meet, and are hashed one after the other.
    """
    key = ["conv_id", "depth"]
    n = partitions(ends.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, ids = (batch.column(c).to_pylist() for c in ("conv_id", "depth", "id"))
            out, at = [], 0
            for to in range(1, len(conv) + 1):
                if to == len(conv) or to - at == PIECE or (conv[to], depth[to]) != (conv[at], depth[at]):
                    out.append((conv[at], depth[at], ids[at], ",".join(map(str, ids[at:to]))))
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, []

        def emit() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * 3
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], [*key, "ends_sha256"])
            done.clear()
            return batch

        for batch in batches:
            for conv, depth, piece in zip(*(batch.column(c).to_pylist() for c in (*key, "piece")), strict=True):
                if (conv, depth) != last:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = (conv, depth), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield emit()
        if last is not None:
            done.append((*last, state.hexdigest()))
            yield emit()

    dealt = ends.repartitionByRange(n, *key, "id").sortWithinPartitions(*key, "id")
    joined = dealt.mapInArrow(pieces, "conv_id long, depth long, first long, piece string")
    return joined.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(items: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of items (conv_id, depth from 1, item, bytes); convs (conv_id, length) has turnless ones too.

    Per node: conv_id (its owner), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (bytes
    that its subtree's turns are repeated by) and ends_sha256 (of the ids of the conversations that end here).
    """
    spark = items.sparkSession
    convs = cut(convs)
    total = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    if not total["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    prefixes = cut(with_keys(items))
    owners = cut(prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")))
    chains = cut(_first_owned(prefixes, convs, owners.where("n_convs > 1").select(*KEY, "owner"), total["root"]))

    top = spark.range(1).select(F.lit(total["root"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(total["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved"))
    nodes = owners.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")).unionByName(top)
    owned = chains.where("head <= length")

    hung = owned.where("above IS NOT NULL").select("conv_id", "above", (F.col("head") - 1).alias("at"))
    bare = owned.select("conv_id", "above", F.col("length").alias("depth")).join(hung.select(F.col("above").alias("conv_id"), F.col("at").alias("depth")).distinct().withColumn("forks", F.lit(1)), ["conv_id", "depth"], "left")
    own = bare.select("conv_id", "above", F.when(F.col("forks").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    sums = cut(_subtree_sums(own.join(nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved")), "conv_id")))

    below = hung.join(sums, "conv_id").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("forks"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("hung_saved"))
    each = nodes.join(below, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "n_convs", F.coalesce("forks", F.lit(0)).alias("forks"), F.coalesce("leaves", F.lit(0)).alias("leaves"), (F.col("saved") + F.coalesce("hung_saved", F.lit(0))).alias("saved")
    )
    each = cut(each)
    # a node's subtree: all of its chain's, without what hangs above it
    upto = running(each.select("conv_id", "depth", "n_convs", "forks", F.col("leaves").alias("own_leaves"), F.col("saved").alias("own_saved"), "leaves", "saved"), "conv_id", "depth", ["leaves", "saved"])
    whole = owned.join(sums.withColumnsRenamed({"leaves": "all_leaves", "saved": "all_saved"}), "conv_id")
    ends = chains.select(F.when(F.col("head") <= F.col("length"), F.col("conv_id")).otherwise(F.col("above")).alias("owner"), F.col("length").alias("depth"), F.col("conv_id").alias("id"))
    lists = id_list_digests(ends.withColumnRenamed("owner", "conv_id"))
    return (
        upto.join(whole, "conv_id")
        .join(lists, ["conv_id", "depth"], "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > F.col("head"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
            "n_convs",
            (F.col("forks") + F.when(F.col("depth") < F.col("length"), 1).otherwise(0)).alias("n_children"),
            (F.col("all_leaves") - F.col("leaves") + F.col("own_leaves")).alias("n_leaves"),
            (F.col("all_saved") - F.col("saved") + F.col("own_saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def trie_report(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of turns (conv_id, turn, role, text)."""
    return prefix_trie(*rebuilt(turns))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations as they are, each node with the role and text of its last turn (null at the root)."""
    items, convs = ordered(turns)
    items = cut(items)
    said = turns.select(turn_digest().alias("item"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["item"])
    nodes = prefix_trie(items, convs)
    return nodes.join(items.select("conv_id", "depth", "item"), ["conv_id", "depth"], "left").join(said, "item", "left").drop("item")


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS l FROM t GROUP BY conv_id
), bits AS (
  SELECT i, CASE WHEN r8 & 1 = 1 THEN xor(r8 >> 1, 3988292384) ELSE r8 >> 1 END AS c FROM (
  SELECT i, CASE WHEN r7 & 1 = 1 THEN xor(r7 >> 1, 3988292384) ELSE r7 >> 1 END AS r8 FROM (
  SELECT i, CASE WHEN r6 & 1 = 1 THEN xor(r6 >> 1, 3988292384) ELSE r6 >> 1 END AS r7 FROM (
  SELECT i, CASE WHEN r5 & 1 = 1 THEN xor(r5 >> 1, 3988292384) ELSE r5 >> 1 END AS r6 FROM (
  SELECT i, CASE WHEN r4 & 1 = 1 THEN xor(r4 >> 1, 3988292384) ELSE r4 >> 1 END AS r5 FROM (
  SELECT i, CASE WHEN r3 & 1 = 1 THEN xor(r3 >> 1, 3988292384) ELSE r3 >> 1 END AS r4 FROM (
  SELECT i, CASE WHEN r2 & 1 = 1 THEN xor(r2 >> 1, 3988292384) ELSE r2 >> 1 END AS r3 FROM (
  SELECT i, CASE WHEN i & 1 = 1 THEN xor(i >> 1, 3988292384) ELSE i >> 1 END AS r2 FROM (SELECT unnest(range(256))::BIGINT AS i))))))))
), tab AS (
  SELECT list(c ORDER BY i) AS c FROM bits
), h AS (
  SELECT conv_id, l, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, b: xor(crc >> 8, c[(xor(crc, b) & 255) + 1])), 4294967295::BIGINT) % 9 AS h FROM o, tab
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 5
), p AS (
  SELECT conv_id, d, l[1:d] AS prefix, len(l) AS n, CASE WHEN d > 0 THEN strlen(l[d].text) ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM r)
), v AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM p GROUP BY prefix, d
), c AS (
  SELECT u.conv_id, u.depth, count(w.depth) AS n_children FROM v u LEFT JOIN v w ON w.depth = u.depth + 1 AND w.prefix[1:u.depth] = u.prefix GROUP BY u.conv_id, u.depth
), s AS (
  SELECT u.conv_id, u.depth, sum(w.own) AS saved, sum((k.n_children = 0)::BIGINT) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM v) w
  JOIN c k ON k.conv_id = w.conv_id AND k.depth = w.depth
  JOIN v u ON u.depth = w.up AND u.prefix = w.prefix[1:w.up] GROUP BY u.conv_id, u.depth
)
SELECT u.conv_id, u.depth, q.conv_id AS parent_conv_id, u.n_convs, c.n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM v u JOIN c ON c.conv_id = u.conv_id AND c.depth = u.depth JOIN s ON s.conv_id = u.conv_id AND s.depth = u.depth
LEFT JOIN v q ON q.depth = u.depth - 1 AND q.prefix = u.prefix[1:u.depth - 1]
"""
