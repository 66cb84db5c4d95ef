"""Links from candidate buckets, without all pairs of a bucket, and their connected components.

Ids are 64-bit hashes, so that contraction by the least neighbour shrinks any graph in a few rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, partitions, release


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges(a, b): distributed union-find by contraction, pointers and all kept in tables.

    In each round every id points to the least id beside it, and the edges are drawn again between what is pointed to.
    """
    steps: list[DataFrame] = []
    while True:
        edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("root"))
        steps.append(parent)
        left = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return cut(out)


def linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) of the components that links join further. roots: as components gives them, of the links before."""
    of = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
    ends = links.join(of("a"), "a", "left").select("b", F.coalesce("ra", "a").alias("ra"))
    ends = ends.join(of("b"), "b", "left").select(F.col("ra").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = components(ends)
    moved = roots.join(tops.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return cut(moved.unionByName(tops.join(roots, "id", "left_anti")))


def shared_buckets(keys: DataFrame, *more: str) -> DataFrame:
    """(key, id, more) of the keys that more than one id has. keys: (key, id, more). One shuffle."""
    bucket = Window.partitionBy("key")
    spread = keys.repartition(partitions(keys.sparkSession), "key").select("key", "id", *more, F.min("id").over(bucket).alias("low"), F.max("id").over(bucket).alias("high"))
    return spread.where("low <> high").select("key", "id", *more)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with their component as root, of those keys whose members are in more than one."""
    rooted = members.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return cut(rooted.join(mixed, "key", "left_semi"))


def _pivots(members: DataFrame, r: int) -> DataFrame:
    """(id, pivot): for each id one other member of one of its buckets.

    At first the member that meets most others, since the centre of a group of near copies is like more of them than any
    other; then members by hash.
    """
    if r == 0:
        met = members.join(members.groupBy("key").agg(F.count("*").alias("g")), "key").groupBy("id").agg(F.sum("g").alias("weight"))
    else:
        met = members.select("id").distinct().select("id", F.xxhash64("id", F.lit(r)).alias("weight"))
    weighed = members.select("key", "id").join(met, "id")
    heads = weighed.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("head"))
    chosen = members.select("key", "id").join(heads, "key").groupBy("id").agg(F.max("head").alias("head"))
    return chosen.select("id", F.col("head.id").alias("pivot")).where("id <> pivot")


#: Columns of each id, and a lower bound of the distance of two ids over these columns with the endings _a and _b.
Sketch = tuple[DataFrame, Column]


def rare_prefix(tokens: DataFrame, least: float) -> DataFrame:
    """(key, id, n, place): the tokens of each set that a set as like it as least must share one of.

    tokens: distinct (id, n, token), n the size of the set. In any one order of all tokens, two sets with a Jaccard similarity
    of least or more share a token among the first n - ceil(least n) + 1 of each. Rare tokens go first, so a passage that many
    sets have makes no bucket unless the sets have nearly nothing else. A token of one set alone takes its place and goes.
    """
    common = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    mine = Window.partitionBy("id")
    ranked = tokens.join(common, "token").withColumn("place", F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("c", "token")))
    prefix = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    return shared_buckets(prefix.select(F.col("token").alias("key"), "id", "n", "place"), "n", "place")


def _unsettled_pairs(members: DataFrame, least: float, pivots: int, sketch: Sketch | None) -> DataFrame:
    """Pairs (a, b) of different components in a bucket that sizes, places and distances to common pivots allow.

    The members of a bucket's largest component are not paired with each other: only those outside it meet all the rest.
    """
    far = 1.0 - least
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("g")).groupBy("key").agg(F.max(F.struct("g", "root")).alias("main"))
    members = _with_sketch(members, sketch)
    marked = members.join(sizes.select("key", F.col("main.root").alias("main")), "key")
    sides = [c for c in members.columns if c != "key"]
    left = marked.where("root <> main").select("key", "main", *[F.col(c).alias(f"{c}_a") for c in sides])
    right = members.select("key", *[F.col(c).alias(f"{c}_b") for c in sides])
    overlap = (F.col("n_a") + F.col("n_b")) * (least / (1.0 + least)) - 1e-6
    # the first token that two sets share has all that they share behind it, in both
    alike = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("id_a") < F.col("id_b")))
    alike &= (F.col("n_a") - F.col("place_a") + 1 >= overlap) & (F.col("n_b") - F.col("place_b") + 1 >= overlap)
    for r in range(pivots):
        within = (F.col(f"lo{r}_a") - F.col(f"hi{r}_b") <= far + 1e-9) & (F.col(f"lo{r}_b") - F.col(f"hi{r}_a") <= far + 1e-9)
        alike &= (F.col(f"p{r}_a") != F.col(f"p{r}_b")) | within
    if sketch is not None:
        alike &= sketch[1] <= far + 1e-9
    bound = [] if sketch is None else [sketch[1].alias("lo")]
    return left.join(right, "key").where(alike).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), *bound).distinct()


def _with_sketch(members: DataFrame, sketch: Sketch | None) -> DataFrame:
    return members if sketch is None else members.join(sketch[0], "id")


def bucket_links(members: DataFrame, distance: Callable[[DataFrame], DataFrame], tokens: Callable[[DataFrame], DataFrame], least: float, direct: int = 1, rounds: int = 2, sketch: Sketch | None = None) -> DataFrame:
    """Links (a, b) that join the same ids as all pairs of every bucket with a Jaccard similarity of least or more would.

    members: (key, id) of shared buckets. distance: pairs (a, b) -> (a, b, lo, hi), bounds of 1 - similarity that are equal
    where it is known; it has to be known where it is 1 - least or less. tokens: (id) -> (id, n, token), the sets themselves.
    sketch, if given, keeps pairs that cannot be similar from being made at all; its bound goes to distance with them, as lo.
    First every id is compared with one member of its buckets. Where a bucket then is in several components, one of `direct`
    members or fewer is compared pair by pair, which costs each member so many comparisons at most. The ids of larger ones are
    dealt again by the rare part of their sets, exactly (rare_prefix), and again compared with one pivot each, in some rounds.
    Of what then remains in one bucket and in different components, pairs are compared only if sizes, places and the triangle
    inequality allow a link.
    """
    spark = members.sparkSession
    far = 1.0 - least + 1e-9

    def compared(pairs: DataFrame) -> DataFrame:
        return cut(distance(pairs.select(F.col("pivot").alias("a"), F.col("id").alias("b"))))

    links = compared(_pivots(members, 0)).where(F.col("hi") <= far).select("a", "b")
    roots = components(links)
    members = _open(members, roots)
    if direct > 1 and not members.isEmpty():
        sizes = members.groupBy("key").agg(F.count("*").alias("g"))
        few = members.join(sizes.where(F.col("g") <= direct).select("key"), "key", "left_semi")
        few = _with_sketch(few, sketch)
        side = lambda x: few.select("key", *[F.col(c).alias(f"{c}_{x}") for c in few.columns if c != "key"])
        alike = (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b"))
        if sketch is not None:
            alike &= sketch[1] <= far
        bound = [] if sketch is None else [sketch[1].alias("lo")]
        pairs = side("a").join(side("b"), "key").where(alike).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), *bound).distinct()
        found = cut(distance(pairs).where(F.col("hi") <= far).select("a", "b"))
        links = links.unionByName(found)
        release(spark)
        roots = linked(roots, found)
        members = _open(members.join(sizes.where(F.col("g") > direct).select("key"), "key", "left_semi"), roots)
    if members.isEmpty():
        return links
    members = cut(rare_prefix(tokens(members.select("id").distinct()), least))
    release(spark)
    members = _open(members, roots)
    for r in range(rounds):
        if members.isEmpty():
            return links
        known = compared(_pivots(members, r))
        found = known.where(F.col("hi") <= far).select("a", "b")
        links, roots = links.unionByName(found), linked(roots, found)
        place = known.select(F.col("b").alias("id"), F.col("a").alias(f"p{r}"), F.col("lo").alias(f"lo{r}"), F.col("hi").alias(f"hi{r}"))
        # an id that is its own pivot is at distance 0
        placed = members.join(place, "id", "left").withColumns({f"p{r}": F.coalesce(f"p{r}", "id"), f"lo{r}": F.coalesce(f"lo{r}", F.lit(0.0)), f"hi{r}": F.coalesce(f"hi{r}", F.lit(0.0))})
        members = _open(placed, roots)
        release(spark)
    pairs = _unsettled_pairs(members, least, rounds, sketch)
    return links.unionByName(distance(pairs).where(F.col("hi") <= far).select("a", "b"))
