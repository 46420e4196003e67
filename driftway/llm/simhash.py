"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints with at most two differing bits differ in at
most one bit of one segment. So every fingerprint probes, for each segment, the small Hamming ball of radius one around
its own value; the table holds each fingerprint under its exact segment values; matches are verified over all 64 bits.

A segment value shared by many distinct fingerprints would give a quadratic number of matches. Such values are counted
first, and their members and probes are linked in another exact way: two fingerprints differ in at most two bits just when
the balls of radius one around the whole fingerprints meet, so members are gathered by the points of these balls. Both
ways give true links only, and together lose none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import blank_words, map_batches, written

SHINGLE = 3
SEED = 42
#: Distinct fingerprints under one segment value up to which matches are formed one by one.
TABLE_LIMIT = 32
#: Rounds after which the search for components reports that it did not settle.
MAX_ROUNDS = 60


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles; zero when there is no word."""
    words = blank_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(values: np.ndarray) -> int:
    """Signed 64-bit fingerprint of unsigned 64-bit hashes: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(values), 4096):
        counts += np.unpackbits(values[start : start + 4096, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""

    def rows(batch):
        found = pa.array([fingerprint(t) for t in batch.column(2).to_pylist()], pa.int64())
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "fp": found}

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    return map_batches(own, rows, "doc_id long, text_hash long, fp long")


def _segments(fps: DataFrame, ball: bool) -> DataFrame:
    """One row per fingerprint, segment and value: its own value, or every value of the ball of radius one."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32 if ball else 0)])
    pair = F.explode(F.array(F.struct(F.lit(0).alias("part"), low.alias("own")), F.struct(F.lit(1).alias("part"), high.alias("own"))))
    return fps.select("fp", pair.alias("s")).select(
        "fp", "s.part", F.explode(F.transform(flips, lambda flip: F.col("s.own").bitwiseXOR(flip))).alias("value")
    )


def links(fps: DataFrame, limit: int = TABLE_LIMIT) -> DataFrame:
    """(a, b), a > b: fingerprints that differ in one or two bits, enough pairs to join all that are linked.

    ``fps`` has one row (fp) per distinct fingerprint.
    """
    key = ["part", "value"]
    held = _segments(fps, ball=False)
    crowded = written(held.groupBy(*key).count().filter(F.col("count") > limit).select(*key), "crowded")
    sparse = held.join(crowded, key, "left_anti").select(*key, F.col("fp").alias("held"))
    probes = _segments(fps, ball=True)
    fetched = (
        probes.join(sparse, key)
        .filter((F.col("fp") != F.col("held")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("held"))) <= 2))
        .select(F.greatest("fp", "held").alias("a"), F.least("fp", "held").alias("b"))
    )
    return fetched.unionByName(_crowded_links(probes, crowded)).distinct()


def _crowded_links(probes: DataFrame, crowded: DataFrame) -> DataFrame:
    """Links among the fingerprints that probe a crowded value, through shared points of their balls of radius one."""
    involved = probes.join(crowded, ["part", "value"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    points = involved.select("fp", F.explode(F.transform(flips, lambda flip: F.col("fp").bitwiseXOR(flip))).alias("point"))
    # a point has at most 65 fingerprints around it, so these groups stay small
    around = points.groupBy("point").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return around.select(F.explode("all").alias("a"), "b").filter(F.col("a") > F.col("b"))


def components(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) for every node on an edge (a, b), where root is the smallest node that can be reached.

    Each round points every node to the smallest root among its neighbours and then follows that pointer; tables are
    written between rounds, so lost executors cost one round at most. No group of a node is collected.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    for _ in range(rounds):
        around = (
            both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        )
        met = labels.join(around, labels["node"] == around["a"], "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")
        )
        # the old root, too, learns of the smaller one: whole trees are hung at once
        hooks = met.filter("root < old").groupBy(F.col("old").alias("node")).agg(F.min("root").alias("hook"))
        hung = met.join(hooks, "node", "left").select("node", "old", F.least("root", F.coalesce("hook", "root")).alias("root"))
        hung = written(hung, "labels")
        up = hung.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = written(hung.join(up, "root", "left").select("node", "old", F.coalesce("above", "root").alias("root")), "labels")
        labels = after.select("node", "root")
        if after.filter("old <> root").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds.")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (the fingerprint that stands for the group) and component_id of every row."""
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "nodes")
    found = written(components(links(nodes.select("fp"))).withColumnRenamed("node", "fp").join(nodes, "fp"), "linked")
    names = found.groupBy("root").agg(F.min("doc").alias("name"))
    linked = found.join(names, "root").select("fp", "root", "name")
    named = nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNotNull(), F.col("name")).otherwise(F.col("doc")).alias("component_id")
    )
    return rows.join(named, "fp")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of up to two bits.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal fingerprints are one node,
    whatever their number. Rows with a null id get the group of their fingerprint but give it no name; a group of null
    ids alone has a null component_id. Repeated rows stay. Extra columns are ignored.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id (null last), then text hash.

    Of rows that repeat an id with the same text, one stays.
    """
    return first_of_each(docs, written(_grouped(docs).select("doc_id", "text_hash", "root"), "groups"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` that stands for each group, from (doc_id, text_hash, root) of every row."""
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("k"), "doc_id", "text_hash")).alias("w"))
    best = best.select(F.col("w.doc_id").alias("_id"), F.col("w.text_hash").alias("_hash"))
    mine, text_hash = docs["doc_id"].cast("long"), F.xxhash64(docs["text"])
    kept = docs.join(best, mine.eqNullSafe(best["_id"]) & (text_hash == best["_hash"]), "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    if repeated.isEmpty():
        return kept
    same = kept["doc_id"].cast("long").eqNullSafe(repeated["_id"]) & (F.xxhash64(kept["text"]) == repeated["_hash"])
    # by text too: under one id, or under no id, the winners of several groups differ in their texts
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(once)
