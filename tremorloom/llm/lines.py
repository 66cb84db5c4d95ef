"""Line dedup with DataFrame functions only: fuzzy lines by MinHash, one line of each group stays.

Lines are compared without the blanks around them. Equal lines become one class first. Each class's signature is taken over
all of its character shingles by one permutation: a shingle's hash falls in one of HASHES bins, and the least hash of each bin
counts. An empty bin takes the value of the next one that is not, marked by the distance, so short lines have full signatures
too, and how often a line repeats a shingle plays no part. BANDS bands of ROWS bins give the candidate keys; at a Jaccard
similarity of 0.8 a pair shares one with a probability of 0.99, of a few percent less where many bins are empty.
Candidates are verified on their exact sets of shingles, by graph.bucket_links, and linked lines are joined by
graph.components. Of each component the line of the least doc_id stays, in that document's order the first.

A line of fewer than SHINGLE characters is one shingle. Blank lines always stay. Null and empty texts stay as they are.
Rows with equal doc_id, and rows with a null doc_id, which come last, are treated alike: of a repeated line each of them keeps
its first copy. Every document stays, even one whose lines all go, with an empty text. Other columns, whatever their names,
stay unchanged; only lines_removed is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, partitions, release
from tremorloom.llm.graph import bucket_links, components, shared_buckets

SHINGLE = 8
ROWS, BANDS = 4, 10
HASHES = ROWS * BANDS
SIMILARITY = 0.8
#: Words of 64 bits of a line's parity sketch, a power of two.
SKETCH = 64
#: Members of a bucket that are compared pair by pair; the rest of a larger bucket is dealt again, see graph.bucket_links.
#: Dealing a line again takes a row for each of a fifth of its shingles, as dear as some thousand comparisons of sketches.
DIRECT = 1024
_LAST = (1 << 63) - 1


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def lines_of(docs: DataFrame, text: str = "text", more: Sequence[Column] = ()) -> DataFrame:
    """(doc, more, line) of the lines of each text that are not blank, repeated ones too."""
    found = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), *more, F.explode(F.split(F.col(text), "\n")).alias("line"))
    return found.withColumn("line", bare(F.col("line"))).where("line <> ''")


def id_of(line: Column) -> Column:
    return F.xxhash64(line)


def check_of(line: Column) -> Column:
    """A second hash: lines are the same only if both agree, so that no line goes for a chance match of one."""
    return F.xxhash64(F.lit(1), line)


def _mark(step: int) -> int:
    """A fixed scramble for each step that an empty bin looks ahead."""
    x = (step * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep, h): a hash of every shingle of every line, repeated ones too."""
    # four bytes a character, so a shingle is cut out at a known byte; the generator keeps a line from being encoded for each
    coded = lines.select(*keep, F.explode(F.array(F.encode("line", "UTF-32"))).alias("code"))
    places = F.greatest(F.lit(1), (F.octet_length("code") / 4).cast("int") - SHINGLE + 1)
    placed = coded.select(*keep, "code", F.explode(F.sequence(F.lit(1), places)).alias("place"))
    return placed.select(*keep, F.xxhash64(F.substring("code", F.col("place") * 4 - 3, F.lit(4 * SHINGLE))).alias("h"))


def signatures(lines: DataFrame) -> DataFrame:
    """(id, m0, m1, ...): the least hash of each bin of each line's shingles; empty bins filled from the next ones, by doubling."""
    placed = shingle_hashes(lines, "id").withColumn("bin", F.pmod(F.shiftrightunsigned("h", 40), F.lit(HASHES)).cast("int"))
    # one minimum a row and bin first, so that the comparisons with every bin are made for bins and not for shingles
    least = placed.groupBy("id", "bin").agg(F.min("h").alias("h"))
    signed = least.groupBy("id").agg(*[F.min(F.when(F.col("bin") == i, F.col("h"))).alias(f"m{i}") for i in range(HASHES)])
    step = 1
    while step < HASHES:
        signed = signed.select("id", *[F.coalesce(F.col(f"m{i}"), F.col(f"m{(i + step) % HASHES}").bitwiseXOR(F.lit(_mark(step)))).alias(f"m{i}") for i in range(HASHES)])
        step *= 2
    return signed


def band_keys(lines: DataFrame) -> DataFrame:
    """(key, id) for each band of each line's signature."""
    bands = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    return signatures(lines).select("id", F.explode(F.array(*bands)).alias("key"))


def sketched(lines: DataFrame) -> DataFrame:
    """(id, most, w0, w1, ...): the number of different shingles of each line, and SKETCH words of bits that they set."""
    spread = lines.repartition(partitions(lines.sparkSession), "id")
    place = shingle_hashes(spread, "id").distinct().select("id", F.shiftrightunsigned("h", 40).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    word = F.shiftright("place", 6).bitwiseAND(F.lit(SKETCH - 1)).cast("int")
    set_bits = place.groupBy("id", word.alias("word")).agg(F.count("*").alias("c"), F.bit_or(bit).alias("bits"))
    words = [F.coalesce(F.max(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(SKETCH)]
    return set_bits.groupBy("id").agg(F.sum("c").alias("most"), *words)


def shingle_sets(lines: DataFrame) -> DataFrame:
    """(id, set): the hashes of the shingles of each line, each once."""
    return shingle_hashes(lines, "id").groupBy("id").agg(F.collect_set("h").alias("set"))


def _apart() -> Column:
    """Least Jaccard distance that the sketches of a line a and a line b leave.

    A bit that one of them alone has stands for a shingle that the other has not, so the sets differ in as many shingles at
    least; and the fewer shingles there are, the farther they are apart. A quarter of the words is enough for most pairs.
    """
    bits = [F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(SKETCH)]
    bound = lambda apart: 2.0 * apart / (F.col("most_a") + F.col("most_b") + apart)
    few = bound(sum(bits[1 : SKETCH // 4], bits[0]))
    return F.when(few > 1.0 - SIMILARITY + 1e-9, few).otherwise(bound(sum(bits[1:], bits[0])))


def _distance(texts: DataFrame, sketches: DataFrame):
    """Bounds of the Jaccard distance of pairs: sketches first, and the sets themselves where these leave a link possible.

    Pairs that bring the sketches' bound lo are not compared by sketches again.
    """
    side = lambda x: sketches.select(*[F.col(c).alias(f"{c}_{x}") for c in sketches.columns]).withColumnRenamed(f"id_{x}", x)

    def of(pairs: DataFrame) -> DataFrame:
        reach = cut(pairs if "lo" in pairs.columns else pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", _apart().alias("lo")))
        near = reach.where(F.col("lo") <= 1.0 - SIMILARITY + 1e-9).select("a", "b")
        # each line's set is taken once, however many pairs it is in
        met = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = cut(shingle_sets(texts.join(met, "id", "left_semi")))
        given = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")).hint("shuffle_hash")
        both = near.join(given("a"), "a").join(given("b"), "b")
        sizes = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"), (F.size("set_a") + F.size("set_b")).alias("sum"))
        exact = sizes.select("a", "b", (1.0 - F.col("shared") / (F.col("sum") - F.col("shared"))).alias("lo"))
        return exact.withColumn("hi", F.col("lo")).unionByName(reach.where(F.col("lo") > 1.0 - SIMILARITY + 1e-9).withColumn("hi", F.lit(1.0)))

    return of


def _tokens(texts: DataFrame):
    def of(ids: DataFrame) -> DataFrame:
        found = shingle_hashes(texts.join(ids, "id", "left_semi"), "id").distinct()
        return found.select("id", F.count("*").over(Window.partitionBy("id")).alias("n"), F.col("h").alias("token"))

    return of


def line_roots(docs: DataFrame) -> DataFrame:
    """(id, check, root) of the classes of equal lines that have links."""
    classes = lines_of(docs).select(id_of(F.col("line")).alias("id"), "line").groupBy("id").agg(F.min("line").alias("line"))
    members = cut(shared_buckets(band_keys(classes)))
    release(docs.sparkSession)
    texts = cut(classes.join(members.select("id").distinct().hint("shuffle_hash"), "id", "left_semi"))
    release(docs.sparkSession)
    sketches = cut(sketched(texts))
    roots = components(bucket_links(members, _distance(texts, sketches), _tokens(texts), SIMILARITY, DIRECT, sketch=(sketches, _apart())))
    return texts.select("id", check_of(F.col("line")).alias("check")).join(roots, "id")


def keepers(docs: DataFrame) -> DataFrame:
    """(id, check, keeper): each class of equal lines and the doc that keeps it, null if a line like it stays instead."""
    roots = cut(line_roots(docs))
    release(docs.sparkSession)
    lines = lines_of(docs).select("doc", id_of(F.col("line")).alias("id"), check_of(F.col("line")).alias("check"))
    owners = lines.groupBy("id", "check").agg(F.min("doc").alias("owner"), F.count("*").alias("copies"))
    # a line that is there once, with none like it, needs no decision
    rooted = cut(owners.join(roots, ["id", "check"], "left").where("copies > 1 OR root IS NOT NULL"))
    leaders = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min_by("id", F.struct("owner", "id")).alias("leader"))
    keeper = F.when(F.col("leader").isNull() | (F.col("leader") == F.col("id")), F.col("owner"))
    return rooted.join(leaders, "root", "left").select("id", "check", keeper.alias("keeper"))


def gone_lines(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """(doc, text_hash, gone): the lines that go, for each doc and hash of a text, so that an array holds a text's own lines however many rows share a doc_id."""
    placed = lines_of(docs.select("doc_id", "text"), more=[F.xxhash64("text").alias("text_hash")])
    placed = placed.select("doc", "text_hash", id_of(F.col("line")).alias("id"), check_of(F.col("line")).alias("check"))
    gone = placed.join(decided, ["id", "check"]).where("keeper IS NULL OR keeper <> doc")
    return gone.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("id", "check")).alias("gone"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with columns lines_removed and text, from which the repeated lines are gone."""
    names = [c for c in docs.columns if c not in ("text", "lines_removed")]
    gone = gone_lines(docs, cut(keepers(docs)))
    release(docs.sparkSession)
    # the row is carried as one column, so no name of it can clash
    rows = docs.select(F.struct(*docs.columns).alias("given"), F.col("text"), F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("text_hash"))
    joined = rows.select("given", "doc", "text_hash").join(gone, ["doc", "text_hash"], "left").withColumn("text", F.col("given.text"))
    named = lambda x: (id_of(x).alias("id"), check_of(x).alias("check"))
    # a mark for each gone line goes before the lines that equal it, so after sorting a line that follows its like goes
    marks = F.transform(F.coalesce("gone", F.array().cast("array<struct<id:bigint,check:bigint>>")), lambda g: F.struct(g["id"].alias("id"), g["check"].alias("check"), F.lit(-1).alias("i"), F.lit("").alias("line")))
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(*named(bare(x)), i.alias("i"), x.alias("line")))
    sorted_rows = joined.withColumn("parts", F.sort_array(F.concat(marks, parts)))
    before = lambda i: F.get(F.col("parts"), i - 1)
    first = lambda x, i: (i == 0) | (before(i)["id"] != x["id"]) | (before(i)["check"] != x["check"])
    stays = F.filter("parts", lambda x, i: (x["i"] >= 0) & ((bare(x["line"]) == "") | first(x, i)))
    ordered = F.sort_array(F.transform(stays, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"))))
    # the generator keeps a filter on the result from sorting the lines anew for each of its conditions
    cleaned = sorted_rows.select("given", "text", F.explode(F.array(ordered)).alias("stays"))
    removed = F.size(F.split("text", "\n")) - F.size("stays")
    return cleaned.select(*[F.col("given").getField(c).alias(c) for c in names], F.array_join(F.transform("stays", lambda x: x["line"]), "\n").alias("text"), removed.cast("long").alias("lines_removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the SHA-256 of the text that stays (null: empty)."""
    kept = without_repeated_lines(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines")))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
