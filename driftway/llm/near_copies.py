"""Near copies by word shingles: every pair of texts with Jaccard similarity of at least 4/5, found and verified exactly.

First come SimHash fingerprints of the shingle sets: those that are equal or differ in at most two bits are found by
multi-index hashing (``simhash.links``), their sets are compared exactly, and what they link are the first groups.

At similarity 0.8 fingerprints are about ten bits apart, too far for any index over segments of 64 bits. So pairs from
different groups are looked for once more, by the shingles themselves. All shingles are put in one order; two sets with
similarity of at least 4/5 share one of the first n - ceil(4n/5) + 1 shingles of each, where n is the set's own size,
whatever the order is. Shingles that a sample shows in many texts come last in it, so boilerplate does not gather unlike
texts.

Under a shingle that few sets hold, all pairs are verified. Under a crowded one, all are verified with a few leaders first;
where this leaves members of a few more in different groups, every pair of members from different groups is verified. Only
pairs inside one group are left out, and they can't change it.

A large crowd that is still apart is dealt to blocks of bounded size, and every two of its blocks meet in one task, which
compares whole sets exactly and returns only the links that join groups (``_in_blocks``). A member is copied once for each
block, 16 times or a few more at most, since larger crowds are split first.

The largest crowds hold texts of one origin, which share most shingles whether they are alike enough or not. So they meet by
what they do not share (``_differences``): a crowd's base is the shingles that over half of it holds, and each set is known by
its differences D from the base, shingles of one but not of the other. Sets x and y differ in D(x) and D(y) where these differ,
and may differ in (n(x) + n(y)) / 9 shingles. So if D(x) and D(y) are that small together, x and y are alike without a look at
them, and so is each with the set that is nearest to the base. All others share differences. With the rarest first, the first
one that x and y share stands behind at most as many in D(x) and D(y) as the pair may differ in. A difference is found in half
of its crowd at most; where it still gathers many, they are a crowd again: one for blocks, or one with a base of its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftway.llm.common import blank_words, give_back, map_batches, shipped, written
from driftway.llm.simhash import components, first_of_each, links, majority
from driftway.session import broadcast_if_small

SHINGLE = 5
SEED = 42
#: Sets under one shingle up to which all pairs are formed at once.
TABLE_LIMIT = 16
LEADERS = 3
#: Sets under one shingle, as a multiple of TABLE_LIMIT, up to which pairs of different groups are formed at once.
CROWD = 4
#: Sets and shingles of a block of a crowd; two blocks are compared by one task. Crowds of more than LARGEST sets are split.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
LARGEST = 16 * BLOCK
#: Shingles that a task lays out at once, as columns of a row for each set.
COLUMNS = 4096
#: One text in so many is read for the order of shingles; one found in COMMON of the sample and in 1/20000 of it comes last.
SAMPLE = 16
COMMON = 2
#: Shingles that the list of common ones may hold (32 MB); of more, those found most often are taken.
MOST_COMMON = 4_000_000
#: Longs of a set's bit map; bits of one set that another lacks bound from below the shingles that the other lacks. With
#: 2,048 bits a map is about a third full at 900 shingles, so that few pairs of unlike texts are left to be verified.
LONGS = 32


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Rising distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = blank_words(text)
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
    return np.unique(np.array(hashes, dtype=np.uint64).view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 shingles, common ones last; both arrays hold rising distinct values."""
    n = len(found)
    if not n:
        return found
    length = n - -(-4 * n // 5) + 1
    last = np.zeros(n, bool)
    if len(common):  # both are in rising order: one binary search for each shingle, whatever the length of the list
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        last = common[at] == found
    return np.concatenate([found[~last][:length], found[last]])[:length]


def mark(found: np.ndarray) -> int:
    """Signed 64-bit hash of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def bit_map(found: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * LONGS, np.uint8)
    bits[found & (64 * LONGS - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _common(own: DataFrame, size: int) -> np.ndarray:
    """Shingles that a sample of the texts shows in many of them, ``MOST_COMMON`` at most. They decide an order, not a result."""
    sample = own.filter(F.pmod("text_hash", F.lit(SAMPLE)) == 0).select("text").distinct()

    def rows(batch):
        return {"held": [shingles(t, size) for t in batch.column(0).to_pylist()]}

    held = written(map_batches(sample, rows, "held array<long>"), "sample")
    least = max(COMMON, held.count() // 20_000)
    counts = written(held.select(F.explode("held").alias("e")).groupBy("e").count().filter(F.col("count") >= least), "common")
    while counts.filter(F.col("count") >= least).count() > MOST_COMMON:
        least *= 2
    found = np.sort(counts.filter(F.col("count") >= least).select("e").toArrow().column(0).to_numpy())
    give_back()  # the driver, too, lives on
    return found


def _marked(own: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, set (its mark), n, fp (SimHash), bit map and prefix of every row."""
    common = own.sparkSession.sparkContext.broadcast(_common(own, size))

    def rows(batch):
        found = [shingles(t, size) for t in batch.column(2).to_pylist()]
        return {
            "doc_id": batch.column(0), "text_hash": batch.column(1), "set": pa.array([mark(f) for f in found], pa.int64()),
            "n": [len(f) for f in found], "fp": pa.array([majority(f.view(np.uint64)) for f in found], pa.int64()),
            "bits": [bit_map(f) for f in found], "prefix": [prefix(f, common.value) for f in found],
        }

    return map_batches(own, rows, "doc_id long, text_hash long, set long, n long, fp long, bits array<long>, prefix array<long>")


def _alike(nodes: DataFrame) -> DataFrame:
    """(a, b), a > b: sets whose fingerprints are equal or differ in one or two bits, enough pairs to join all such sets."""
    firsts = written(nodes.groupBy("fp").agg(F.min("set").alias("set")), "fingerprints")
    one, two = (firsts.select(F.col("fp").alias(k), F.col("set").alias(f"set{k}")) for k in "ab")
    far = links(firsts.select("fp")).join(one, "a").join(two, "b").select("seta", "setb")
    same = nodes.select("fp", F.col("set").alias("seta")).join(firsts.withColumnRenamed("set", "setb"), "fp").filter("seta <> setb")
    both = far.unionByName(same.select("seta", "setb"))
    return both.select(F.greatest("seta", "setb").alias("a"), F.least("seta", "setb").alias("b"))


def _paired(members: DataFrame) -> DataFrame:
    """(a, b), a > b: sets of different groups under one shingle whose sizes allow the similarity."""
    one, two = members.alias("x"), members.alias("y")
    sizes = F.expr("x.set > y.set AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n AND x.root <> y.root")
    return one.join(two, (F.col("x.e") == F.col("y.e")) & sizes).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()


def _starred(crowded: DataFrame) -> DataFrame:
    """(a, b), a > b: members of crowded shingles with the leaders there, where they are not in one group."""
    best = [F.min(F.struct(F.xxhash64("set", F.lit(k)).alias("h"), "set", "n", "root")) for k in range(LEADERS)]
    leaders = crowded.groupBy("e").agg(F.array_distinct(F.array(*best)).alias("l")).select("e", F.explode("l").alias("l"))
    near = (F.col("root") != F.col("l.root")) & (5 * F.col("n") >= 4 * F.col("l.n")) & (5 * F.col("l.n") >= 4 * F.col("n"))
    return crowded.join(leaders, "e").filter(near).select(F.greatest("set", "l.set").alias("a"), F.least("set", "l.set").alias("b")).distinct()


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bit maps allow the similarity; none that has it is lost."""
    p, q = (nodes.select(F.col("set").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")
    lacking = [" + ".join(f"bit_count(bits{x}[{k}] & ~bits{y}[{k}])" for k in range(LONGS)) for x, y in ("ab", "ba")]
    both = pairs.join(p, "a").join(q, "b")
    return both.filter(f"9 * (na - ({lacking[0]})) >= 4 * (na + nb) AND 9 * (nb - ({lacking[1]})) >= 4 * (na + nb)").select("a", "b")


def _sets(needed: DataFrame, own: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(set, held): the whole sets with the marks of ``needed`` (set), made once more from their texts."""
    texts = rows.join(needed, "set", "left_semi").groupBy("set").agg(F.min("text_hash").alias("text_hash")).select("text_hash")
    texts = broadcast_if_small(written(texts, "texts"))

    def read(batch):
        found = [shingles(t, size) for t in batch.column(0).to_pylist()]
        return {"set": pa.array([mark(f) for f in found], pa.int64()), "held": found}

    found = own.join(texts, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text")
    return written(map_batches(found, read, "set long, held array<long>"), "sets")


def _verified(pairs: DataFrame, own: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, by their whole sets."""
    needed = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    sets = _sets(needed, own, rows, size)
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("held").alias("p")), "a")
    both = both.join(sets.select(F.col("set").alias("b"), F.col("held").alias("q")), "b")
    shared = F.size(F.array_intersect("p", "q"))
    return written(both.filter(9 * shared >= 4 * (F.size("p") + F.size("q"))).select("a", "b"), "near")


def _differences(crowds: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of crowds (key, set, root): alike pairs (a, b) by differences from the base alone, and the differences by which others meet.

    The latter are rows (key, d, set, n, root, k, p): set has k differences, and p of them are before d. Sets known to be alike
    have one root there.
    """
    whole = written(crowds.join(sets, "set"), "crowds")
    held = written(whole.select("key", F.explode("held").alias("d")).groupBy("key", "d").agg(F.count("*").alias("c")).filter("c > 1"), "held")
    counts = held.join(whole.groupBy("key").agg(F.count("*").alias("m")), "key")
    bases = counts.filter("2 * c > m").groupBy("key").agg(F.collect_list("d").alias("base"))
    own = whole.join(bases, "key", "left").withColumn("base", F.coalesce("base", F.array().cast("array<long>")))
    own = own.select("key", "set", "root", F.size("held").alias("n"), F.concat(F.array_except("held", "base"), F.array_except("base", "held")).alias("diff"))
    own = written(own.withColumn("k", F.size("diff")).withColumn("s", F.expr("n - 9 * k")), "differences")
    best = own.groupBy("key").agg(F.max(F.struct("s", "set", "root")).alias("best"))
    own = own.join(best, "key").withColumn("star", F.expr("s + best.s >= 0"))
    stars = own.filter("star AND set <> best.set").select(F.greatest("set", "best.set").alias("a"), F.least("set", "best.set").alias("b")).distinct()
    own = own.withColumn("root", F.when(F.col("star"), F.col("best.root")).otherwise(F.col("root")))
    each = own.select("key", "set", "n", "root", "k", F.explode("diff").alias("d")).join(counts, ["key", "d"], "left")
    each = each.withColumn("rare", F.coalesce(F.least("c", F.col("m") - F.col("c")), F.lit(1)))
    each = each.withColumn("p", F.row_number().over(Window.partitionBy("key", "set").orderBy("rare", "d")) - 1)
    places = each.filter("rare > 1 AND 4 * p <= n").select("key", "d", "set", "n", "root", "k", "p")
    return written(stars, "stars"), written(places, "places")


def _meeting(places: DataFrame) -> DataFrame:
    """The differences under which sets of different roots can be alike, with their number t and a hash h of who is there."""
    key = ["key", "d"]
    least = places.groupBy(*key).agg(F.min("k").alias("lk"), F.min(F.expr("2 * p - k")).alias("lq"), F.min("p").alias("lp"))
    # what a pair must meet (see _met), for the whole of those there: a pair may differ in n / 4 at most
    can = places.join(least, key).filter("4 * (2 * p - k + lk) <= n AND 4 * (lq + k) <= n AND 4 * (p + lp) <= n").drop("lk", "lq", "lp")
    can = written(can, "places")
    there = can.groupBy(*key).agg(
        F.count("*").alias("t"), F.bit_xor(F.xxhash64("set")).alias("h"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    return written(can.join(there.filter("low < high").select(*key, "t", "h"), key), "meeting")


def _met(places: DataFrame) -> DataFrame:
    """(a, b), a > b: sets of different roots under one difference, where their places allow that it is the first they share."""
    one, two = places.alias("x"), places.alias("y")
    sizes = "x.set > y.set AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n AND x.root <> y.root"
    ahead = "9 * (x.p + y.p) <= x.n + y.n AND 9 * (2 * x.p - x.k + y.k) <= x.n + y.n AND 9 * (2 * y.p - y.k + x.k) <= x.n + y.n"
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.d") == F.col("y.d"))
    return one.join(two, same & F.expr(f"{sizes} AND {ahead}")).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set of ``x`` shares with each of ``y``; all hold distinct values."""
    shared = np.zeros((len(x), len(y)), np.float32)
    p, q = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(p, q)
    if not len(both):
        return shared
    places = []
    for values, sets in ((p, x), (q, y)):
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        found = both[at] == values
        places.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[found], at[found]))
    for start in range(0, len(both), COLUMNS):
        sides = []
        for (row, column), sets in zip(places, (x, y)):
            here = (column >= start) & (column < start + COLUMNS)
            side = np.zeros((len(sets), COLUMNS), np.float32)
            side[row[here], column[here] - start] = 1
            sides.append(side)
        shared += sides[0] @ sides[1].T
    return shared


def joining(near: np.ndarray, x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """The places (row, column) of ``near`` that are enough to join the roots ``x`` of its rows and ``y`` of its columns."""
    above: dict[int, int] = {}

    def top(root: int) -> int:
        while root in above:
            root = above[root]
        return root

    found = []
    for i, row in enumerate(near):
        for j in np.flatnonzero(row).tolist():
            one, two = top(x[i]), top(y[j])
            if one != two:
                above[max(one, two)] = min(one, two)
                found.append((i, j))
    return found


def _in_blocks(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a > b: alike sets of different roots in crowds (key, set, root, m, blocks), enough to join all of each crowd."""

    def compare(table):
        sides = [table.filter(pc.equal(table["own"], table[k][0])) for k in ("i", "j")]
        held = [[np.array(v.values) for v in side["held"]] for side in sides]
        marks, roots = ([side[k].to_pylist() for side in sides] for k in ("set", "root"))
        pairs = []
        if all(held):
            n = [np.array([len(h) for h in side]) for side in held]
            p, q = n[0][:, None], n[1][None, :]
            near = (np.array(roots[0])[:, None] != np.array(roots[1])[None, :]) & (5 * p >= 4 * q) & (5 * q >= 4 * p)
            if near.any():
                near &= 9 * overlaps(*held) >= 4 * (p + q)
                pairs = [(marks[0][i], marks[1][j]) for i, j in joining(near, *roots)]
        return pa.table({"a": pa.array([max(p) for p in pairs], pa.int64()), "b": pa.array([min(p) for p in pairs], pa.int64())})

    own = crowds.withColumn("own", F.expr("cast(pmod(xxhash64(set, 7), blocks) as long)"))
    dealt = own.select("key", "set", "root", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other")).join(sets, "set")
    met = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "root", "held")
    shipped(crowds.sparkSession)
    return met.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _dissolved(crowded: DataFrame, own: DataFrame, rows: DataFrame, size: int, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Alike pairs (a, b) and pairs to be verified, enough to join all alike members of different roots under one shingle.

    Shingles with one leader are one crowd. Crowds of up to ``LARGEST`` sets end in blocks; each round's others are half as large
    at most, and where a difference gathers up to ``limit`` sets they end as pairs.
    """
    sets = _sets(crowded.select("set").distinct(), own, rows, size)
    leaders = crowded.groupBy("e").agg(F.min(F.struct(F.xxhash64("set").alias("h"), "set")).alias("l")).select("e", F.col("l.set").alias("key"))
    crowds = crowded.join(leaders, "e").select("key", "set", "root", "n").distinct()
    alike, pairs = [], []
    while True:
        blocks = F.ceil(F.count("*") / F.lit(BLOCK)) + F.floor(F.sum("n") / F.lit(BLOCK_SHINGLES))
        sized = crowds.groupBy("key").agg(F.count("*").alias("m"), blocks.cast("long").alias("blocks"))
        crowds = written(crowds.join(sized, "key"), "crowds")
        alike.append(written(_in_blocks(crowds.filter(F.col("m") <= LARGEST), sets), "linked"))
        crowds = crowds.filter(F.col("m") > LARGEST).select("key", "set", "root")
        if crowds.isEmpty():
            return alike, pairs
        stars, places = _differences(crowds, sets)
        meeting = _meeting(places)
        alike.append(stars)
        pairs.append(_met(meeting.filter(F.col("t") <= limit)))
        # differences of the same sets are one crowd
        crowds = meeting.filter(F.col("t") > limit).groupBy(F.col("h").alias("key"), "set").agg(F.min("root").alias("root"), F.min("n").alias("n"))


def _labels(near: DataFrame) -> DataFrame:
    return components(near).select(F.col("node").alias("set"), "root")


def _grouped(docs: DataFrame, size: int, limit: int) -> DataFrame:
    """doc_id, text_hash and root (the smallest mark of the group) of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    rows = written(_marked(own, size), "marked")
    nodes = written(rows.select("set", "n", "fp", "bits").dropDuplicates(["set"]), "nodes")
    near = _verified(written(_possible(_alike(nodes), nodes), "alike"), own, rows, size)
    labels = _labels(near)
    members = rows.select("set", "prefix").dropDuplicates(["set"]).select(F.explode("prefix").alias("e"), "set")
    # most shingles are those of one set: they go as soon as all of a shingle are in one place, and no count is needed
    beside = Window.partitionBy("e").orderBy("set")
    met = members.select("e", "set", F.lag("set").over(beside).alias("_one"), F.lead("set").over(beside).alias("_two"))
    met = written(met.filter("_one IS NOT NULL OR _two IS NOT NULL").select("e", "set"), "met")
    counts = met.groupBy("e").count()
    named = nodes.select("set", "n").join(labels, "set", "left").withColumn("root", F.coalesce("root", "set"))
    shared = written(met.join(named, "set").join(counts, "e"), "shared")
    few, crowded = shared.filter(F.col("count") <= limit), shared.filter(F.col("count") > limit)
    more = _verified(written(_possible(_paired(few).unionByName(_starred(crowded)).distinct(), nodes), "pairs"), own, rows, size)
    if not more.isEmpty():
        near = near.unionByName(more)
        labels = _labels(near)
    split = crowded.drop("root").join(labels, "set", "left").select("e", "set", "n", F.coalesce("root", "set").alias("root"))
    apart = split.groupBy("e").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("e")
    split = written(split.join(apart, "e", "left_semi").join(counts, "e"), "split")
    if not split.isEmpty():
        large = split.filter(F.col("count") > CROWD * limit)
        alike, pairs = ([], []) if large.isEmpty() else _dissolved(large, own, rows, size, CROWD * limit)
        pairs = reduce(DataFrame.unionByName, pairs, _paired(split.filter(F.col("count") <= CROWD * limit))).distinct()
        more = _verified(written(_possible(pairs, nodes), "pairs"), own, rows, size)
        more = written(reduce(DataFrame.unionByName, alike, more), "near")
        if not more.isEmpty():
            labels = _labels(near.unionByName(more))
    return rows.select("doc_id", "text_hash", "set").join(labels, "set", "left").select(
        "doc_id", "text_hash", F.coalesce("root", "set").alias("root")
    )


def deduplicated(docs: DataFrame, size: int = SHINGLE, limit: int = TABLE_LIMIT) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id (null last), then text hash.

    Groups are what can be reached over pairs with a Jaccard similarity of at least 4/5 of their ``size``-word shingles.
    Texts of fewer words are one shingle; null, empty and blank texts are one group. Of rows that repeat an id with the
    same text, one stays.
    """
    return first_of_each(docs, written(_grouped(docs, size, limit), "groups"))
