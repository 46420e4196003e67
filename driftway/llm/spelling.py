"""Groups of spelling variants: words one inserted, deleted or replaced code point apart, by pairs of trie nodes.

All words stand in a trie, and all reversed words in another. Node numbers of the first stand for prefixes, those of the
second for suffixes, so a word cut at a place is a pair of numbers (prefix node, suffix node). One whole word has each of
its cuts to itself. A word that skips the code point at a place has the pair of what is left and right of it. Words that
share a skipping pair differ in that place alone; a word whose cut equals another one's skipping pair lacks that code
point. So the neighbours at distance one are exactly the members of one pair, and a pair has at most one word by its cut
and one for each letter by a skip.

Numbering reads the sorted words once in each range: nodes are numbered as a word leaves the path of the one before. Nodes
on the border of two ranges get the number that the range before gave them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import default_parts, shipped, slices, written

LEAST_LENGTH, LEAST_COUNT, MORE = 7, 2, 10
#: One (document, word) in so many loses a code point.
EVERY = 31
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: A node number: its range, then its number there in so many bits.
_NODE_BITS = 40
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def _lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def words_of(docs: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word and n of all words of at least ``length`` code points that the texts hold ``least`` times or more.

    Words are the runs of letters with A-Z lower-cased; of one (id, run) in ``every``, by the hash of both, a code point
    is left out. A null id is written as nothing before the colon of the hashed text.
    """
    run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % length)  # at the start of a run it takes all of it; shorter runs give no word

    def counted(batches):
        held: Counter = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                name = "%s:" % ("" if doc_id is None else doc_id)
                for found, n in Counter(run.findall(text)).items():
                    word = _lowered(found)
                    h = zlib.crc32((name + word).encode())
                    if h % every == 0:
                        place = h % len(word)
                        word = word[:place] + word[place + 1 :]
                        if len(word) < length:
                            continue
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield rows(held)
                held.clear()
        if held:
            yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    shipped(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def common_start(one: str, two: str) -> int:
    """The number of code points that two words begin with alike."""
    length = min(len(one), len(two))
    if one[:length] == two[:length]:
        return length
    low, high = 0, length  # words may be very long: halve instead of stepping
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if one[:middle] == two[:middle] else (low, middle)
    return low


def numbered(words: DataFrame) -> DataFrame:
    """word and nodes of distinct words (word): the numbers of the trie nodes of its prefixes, from none to all of it."""
    spark = words.sparkSession
    ranged = words.select("word").repartitionByRange(default_parts(spark), "word").sortWithinPartitions("word")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "word")

    def paths(batches):
        last, nodes, following = None, [0], 1
        for batch in slices(batches, 2048):
            found = []
            for word in batch.column(1).to_pylist():
                keep = 0 if last is None else common_start(last, word)
                nodes = nodes[: keep + 1] + list(range(following, following + len(word) - keep))
                following += len(word) - keep
                last = word
                found.append(nodes)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["part", "word", "nodes"]
                )

    shipped(spark)
    local = written(ranged.mapInArrow(paths, "part int, word string, nodes array<long>"), "paths")
    # one row per range: its first and last word, and the path of the last
    ends = local.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("path")).collect()
    borders: dict[int, np.ndarray] = {}
    before = None
    for end in sorted(ends, key=lambda r: r["part"]):
        if before is not None:
            # the first word's nodes have the numbers 0, 1, ... of their depth; those on the border are known before
            path = np.array(before["path"][: common_start(before["last"], end["first"]) + 1], np.int64)
            borders[end["part"]] = _global(path, before["part"], borders)
        before = end

    def resolved(batches):
        for batch in slices(batches, 2048):
            nodes, parts = batch.column(2), batch.column(0).to_numpy()
            lengths = np.diff(nodes.offsets.to_numpy())
            values, spread = nodes.flatten().to_numpy(), np.repeat(parts, lengths)
            out = np.empty(len(values), np.int64)
            for part in np.unique(parts).tolist():
                own = spread == part
                out[own] = _global(values[own], part, borders)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(out))], names=["word", "nodes"])

    return local.select("part", "word", "nodes").mapInArrow(resolved, "word string, nodes array<long>")


def _global(nodes: np.ndarray, part: int, borders: dict[int, np.ndarray]) -> np.ndarray:
    """Numbers that hold for all ranges, from those of one range."""
    known = borders.get(part, np.empty(0, np.int64))
    out = (np.int64(part) << np.int64(_NODE_BITS)) | nodes
    if len(known):
        old = nodes < len(known)
        out[old] = known[nodes[old]]
    return out


def pairs_of(words: DataFrame) -> DataFrame:
    """(prefix, suffix, word, n, skips, opens): the cuts and the skipping pairs of all words (word, n).

    ``opens`` is false for a skip inside a run of one code point, which leaves the same as a skip at the run's start.
    """
    forward = numbered(words).withColumnRenamed("nodes", "f")
    back = numbered(words.select(F.reverse("word").alias("word"))).select(F.reverse("word").alias("word"), F.reverse("nodes").alias("b"))
    both = words.join(forward, "word").join(back, "word")  # b[k] is the node of what follows the first k code points

    def rows(batches):
        for batch in slices(batches, 1024):
            out = {"prefix": [], "suffix": [], "at": [], "skips": [], "opens": []}
            for at, (word, f, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                size = len(word)
                out["prefix"] += f + f[:size]
                out["suffix"] += b + b[1:]
                out["at"] += [at] * (2 * size + 1)
                out["skips"] += [False] * (size + 1) + [True] * size
                out["opens"] += [True] * (size + 2) + [word[k] != word[k - 1] for k in range(1, size)]
            at = pa.array(out["at"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["prefix"], pa.int64()), pa.array(out["suffix"], pa.int64()), batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(out["skips"], pa.bool_()), pa.array(out["opens"], pa.bool_())],
                names=["prefix", "suffix", "word", "n", "skips", "opens"],
            )

    schema = "prefix long, suffix long, word string, n long, skips boolean, opens boolean"
    return both.select("word", "n", "f", "b").mapInArrow(rows, schema)


def near(words: DataFrame) -> DataFrame:
    """word, n_near and best (n, word) of all words (word, n) with a near word; best is the largest, then the smallest word."""
    # at most one word by its cut and one for each letter by a skip: lists are bounded by the alphabet
    member = F.struct((-F.col("n")).alias("less"), "word", "skips", "opens")
    held = pairs_of(words).groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(member)).alias("m")).filter(F.size("m") > 1)
    each = held.select("m", F.explode("m").alias("x")).select("x", F.expr("""
        filter(m, y -> y.word <> x.word AND CASE WHEN x.skips AND y.skips THEN true WHEN x.skips THEN x.opens ELSE y.skips AND y.opens END)
    """).alias("others")).filter(F.size("others") > 0)
    best = F.element_at("others", 1)
    found = each.groupBy("x.word").agg(
        F.sum(F.size("others")).alias("n_near"), F.min(F.struct(best["less"].alias("less"), best["word"].alias("word"))).alias("best")
    )
    return found.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): where following forms ends. Each round doubles the steps that a row has gone."""
    ways = written(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(ways.join(on, "root", "left"), "ways")
        ways = longer.select("word", F.coalesce("further", "root").alias("root"))
        if longer.filter("further IS NOT NULL").isEmpty():
            return ways


def variants(docs: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT, every: int = EVERY, more: int = MORE) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words of the texts.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. The form is the near
    word found most often (of equals the smallest in code-point order), if it is found at least ``more`` times as often;
    else form and form_n are null. The root is where following forms ends, the word itself without a form. Null and empty
    texts hold no words; repeated rows count again; extra columns are ignored; an empty table gives no rows.
    """
    words = written(words_of(docs, length, least, every), "words")
    is_form = F.col("best_n") >= more * F.col("n")
    found = written(words.join(near(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ), "near")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
