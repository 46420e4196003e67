"""Benchmark decontamination by winnowing.

Items and documents are read as words. Every k consecutive words have a hash; winnowing keeps the smallest hash of each
w consecutive ones. Any shared run of k + w - 1 words holds a whole winnowing window, so both sides keep the same hash
there: with k + w - 1 = 13 no shared 13-word window can be missed. Kept document hashes are joined with kept item
hashes; each hit is extended over the windows around it, which are compared word by word.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import lower_words, map_batches, written

WINDOW = 13
K = 5
#: Words of an item that are hashed at once; a longer item is cut into pieces.
BLOCK_WORDS = 100_000
#: Slots for the hashes of the benchmark: 4 MB, whatever its size.
SLOTS = 1 << 22
#: Parts of a hash or window that many documents share.
SALTS = 16

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.empty(0, np.int64)


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    single = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mixed = single[: len(words) - k + 1].copy()
    for at in range(1, k):
        mixed *= _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        mixed += single[at : len(words) - k + 1 + at]
    mixed *= _MULTIPLIER
    return mixed ^ (mixed >> np.uint64(32))


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash (the rightmost, on ties) of every ``width`` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.array([int(np.argmin(hashes))]) if len(hashes) else np.empty(0, np.int64)
    least = hashes[:n].copy()
    at = np.zeros(n, np.int64)
    for shift in range(1, width):
        seen = hashes[shift : shift + n]
        better = seen <= least
        np.copyto(least, seen, where=better)
        at[better] = shift
    return np.unique(at + np.arange(n))


def _pieces(words: list[bytes], window: int, most: int) -> list[list[bytes]]:
    """An item in pieces of at most ``most`` words, each with the window - 1 words before it; every window is in one."""
    most = max(most, 2 * window)
    return [words[at : at + most] for at in range(0, max(len(words) - window + 1, 1), most - window + 1)]


def _tagged(words: list[bytes], length: int, k: int | None = None) -> np.ndarray:
    """Hashes of ``length`` words (short items) or, with ``k``, of the k-grams of long ones; equal only within a length."""
    return (gram_hashes(words, k or length) ^ (np.uint64(length) * _MULTIPLIER)).view(np.int64)


def _kept(items: DataFrame, window: int, k: int, most: int) -> DataFrame:
    """(h, length) of the benchmark, distinct: kept hashes of long items, and whole short items with their length."""

    def rows(batch):
        hashes, lengths = [], []
        for words in map(lower_words, batch.column(1).to_pylist()):
            if len(words) >= window:
                for piece in _pieces(words, window, most):
                    own = gram_hashes(piece, k)
                    hashes.append(_tagged(piece, window, k)[winnow(own, window - k + 1)])
                    lengths.append(np.full(len(hashes[-1]), window))
            elif words:
                hashes.append(_tagged(words, len(words)))
                lengths.append(np.array([len(words)]))
        return {"h": np.concatenate([_NONE, *hashes]), "length": np.concatenate([_NONE, *lengths])}

    return map_batches(items, rows, "h long, length long").distinct()


def _windows(items: DataFrame, window: int, most: int) -> DataFrame:
    """(gram, item_id) of the benchmark, distinct: the words of every window, and of every whole short item."""

    def rows(batch):
        grams, ids = [], []
        for item, words in zip(batch.column(0).to_pylist(), map(lower_words, batch.column(1).to_pylist())):
            for piece in _pieces(words, window, most) if words else []:
                size = min(window, len(piece))
                found = {b" ".join(piece[at : at + size]) for at in range(len(piece) - size + 1)}
                grams += found
                ids += [item] * len(found)
        return {"gram": grams, "item_id": ids}

    return map_batches(items, rows, "gram binary, item_id long").distinct()


def _reader(held, window: int, k: int):
    """Per document: words, the distinct hashes that may be in the benchmark and, where there are any, the text."""

    def rows(batch):
        slots, short = held.value
        n_words, hashes, texts = [], [], []
        for text in batch.column(2).to_pylist():
            words = lower_words(text)
            own = [_NONE]
            if len(words) >= window:
                grams = gram_hashes(words, k)
                own.append(_tagged(words, window, k)[winnow(grams, window - k + 1)])
            own += [_tagged(words, length) for length in short if len(words) >= length]
            found = np.concatenate(own)
            found = np.unique(found[slots[found & (SLOTS - 1)]])
            n_words.append(len(words))
            hashes.append(found)
            texts.append(text if len(found) else None)
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "n_words": n_words, "hashes": hashes, "text": texts}

    return rows


def _extender(window: int, k: int, short: list[int]):
    """The windows of a document around its hits, one row each; place is start * window, plus the length of a short one."""

    def rows(batch):
        marks, places, grams = [], [], []
        for text_hash, text, hits in zip(*(batch.column(c).to_pylist() for c in range(3))):
            words, hits = lower_words(text), np.array(hits, np.int64)
            starts: set = set()
            if len(words) >= window:
                for at in np.flatnonzero(np.isin(_tagged(words, window, k), hits)).tolist():
                    starts.update(range(max(at + k - window, 0), min(at, len(words) - window) + 1))
            found = [(at, window) for at in starts]
            for length in short:
                if len(words) >= length:
                    found += [(at, length) for at in np.flatnonzero(np.isin(_tagged(words, length), hits)).tolist()]
            marks += [text_hash] * len(found)
            places += [at * window + length % window for at, length in found]
            grams += [b" ".join(words[at : at + length]) for at, length in found]
        return {"text_hash": marks, "place": places, "gram": grams}

    return rows


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: words, hit words, items found, and the hit runs (flat starts and ends, in words).

    Neither side is collected: hashes of items and documents meet in a join, and windows around hits in another one, by
    their words. The driver holds which of SLOTS slots the hashes of the benchmark fall into, to spare documents without
    any the joins. An item is cut into overlapping pieces of at most ``block_words`` words. Null and empty texts have no
    words: no hits, not contaminated. A text repeated with its id keeps its row for each time. Items without an id count
    for hits but are not listed; empty items match nothing; an item shorter than the window is one window of its own
    length. Extra columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text")
    )
    kept = written(_kept(items, window, k, block_words), "kept")
    short = sorted(row["length"] for row in kept.select("length").distinct().collect() if row["length"] < window)
    taken = kept.select(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).distinct().toArrow().column(0).to_numpy()
    slots = np.zeros(SLOTS, bool)
    slots[taken] = True
    read = "doc_id long, text_hash long, n_words long, hashes array<long>, text string"
    scanned = written(map_batches(own, _reader(spark.sparkContext.broadcast((slots, short)), window, k), read), "scanned")
    some = scanned.filter(F.size("hashes") > 0)
    asked = some.select("text_hash", F.explode("hashes").alias("h")).distinct()
    hits = asked.withColumn("salt", _salt()).join(kept.select("h", _salts()), ["h", "salt"], "left_semi")
    hits = hits.groupBy("text_hash").agg(F.collect_list("h").alias("hits"))
    texts = some.select("text_hash", "text").dropDuplicates(["text_hash"]).join(hits, "text_hash").select("text_hash", "text", "hits")
    windows = map_batches(texts, _extender(window, k, short), "text_hash long, place long, gram binary").withColumn("salt", _salt())
    met = windows.join(_windows(items, window, block_words).select("gram", "item_id", _salts()), ["gram", "salt"])
    met = met.groupBy("text_hash").agg(F.collect_set("place").alias("places"), F.collect_set("item_id").alias("items"))
    found = written(map_batches(met, _runs_of(window), "text_hash long, runs array<long>, items array<long>"), "found")
    nothing = F.array().cast("array<long>")
    without = scanned.filter(F.size("hashes") == 0).select("doc_id", "text_hash", "n_words", nothing.alias("runs"), nothing.alias("items"))
    joined = some.select("doc_id", "text_hash", "n_words").join(found, "text_hash", "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("runs", nothing).alias("runs"), F.coalesce("items", nothing).alias("items")
    )
    return _counted(without.unionByName(joined))


def _runs_of(window: int):
    """Flat [start, end, start, end, ...] of the words that the windows at ``places`` cover."""

    def rows(batch):
        runs = []
        for places in batch.column(1).to_pylist():
            out: list[int] = []
            for start, end in sorted((at // window, at // window + (at % window or window)) for at in places):
                if out and start <= out[-1]:
                    out[-1] = max(out[-1], end)
                else:
                    out += [start, end]
            runs.append(out)
        return {"text_hash": batch.column(0), "runs": runs, "items": batch.column(2)}

    return rows


def _salt():
    return F.pmod("text_hash", F.lit(SALTS)).cast("int")


def _salts():
    return F.explode(F.array(*[F.lit(at) for at in range(SALTS)])).alias("salt")


def _counted(found: DataFrame) -> DataFrame:
    """Digest columns from runs and items; an odd position of ``runs`` is an end, an even one a start."""
    n_hit = F.aggregate(F.transform("runs", lambda v, k: F.when(k % 2 == 1, v).otherwise(-v)), F.lit(0).cast("long"), lambda a, v: a + v)
    ids = F.array_sort(F.transform("items", lambda v: v.cast("string")))
    return (
        found.withColumn("n_hit", n_hit)
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
            "runs", "text_hash",
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns; null and empty texts stay."""
    found = scan(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"])
    return docs.join(found, same, "left_anti")
