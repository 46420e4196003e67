"""Packing along a space-filling curve.

A document's vector is its hashed token counts, projected by a fixed table of +1 and -1 to four numbers. Scaled and cut
to a grid, they give its place on a Hilbert curve: neighbours on the curve have similar vectors. Documents are
range-sorted by that key, and each range packs its documents one after the other into sequences of fixed length, cutting
where a sequence is full. The one open sequence that each range ends with is joined with those of other ranges.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import default_parts, give_back, map_batches, shipped, slices, written
from driftway.llm.tokens import encoder, vocabulary

LENGTH = 1024
END_ID = 0
#: Numbers per vector and bits per number on the curve (together 60 bits), hashed token classes, seed of the projection.
DIMENSIONS, BITS, CLASSES, SEED = 4, 15, 4096, 11


def projection(classes: int = CLASSES, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return 2 * np.random.default_rng(seed).integers(0, 2, (classes, dimensions)) - 1


_TABLE = projection().astype(np.float64)
#: Documents whose counts of token classes are held at once.
_COUNTED = 64


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of grid points (whole numbers below 2**bits).

    The walk goes from the coarsest to the finest grid. At each level the row's corner, seen in the frame of its cell, is
    read as a Gray code; then the frame turns: low coordinates are mirrored where the corner bit is set, else exchanged
    with the first one.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for k in range(n):
            is_set = (x[k] & bit) != 0
            x[0] = np.where(is_set, x[0] ^ low, x[0])
            swap = np.where(is_set, 0, (x[0] ^ x[k]) & low)
            x[0] ^= swap
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned = np.where((x[n - 1] & (1 << level)) != 0, turned ^ ((1 << level) - 1), turned)
    x ^= turned
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | ((x[k] >> level) & 1)
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given by all their ids one after the other, and their numbers of ids.

    Counts and table are whole numbers, so any machine gets the same.
    """
    out = np.empty(len(lengths), np.int64)
    ends = np.cumsum(lengths)
    for first in range(0, len(lengths), _COUNTED):
        some = lengths[first : first + _COUNTED]
        held = ids[ends[first] - some[0] : ends[first + len(some) - 1]]
        hashed = ((held.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64)
        hashed += np.repeat(np.arange(len(some)) * CLASSES, some)
        counts = np.bincount(hashed, minlength=len(some) * CLASSES).reshape(len(some), CLASSES).astype(np.float64)
        dots = counts @ _TABLE  # sums of whole numbers below 2**53
        norms = np.sqrt(np.maximum(np.einsum("ij,ij->i", counts, counts), 1.0))
        scaled = dots / norms[:, None]  # about normal, with deviation 1
        grid = np.clip((scaled + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        out[first : first + len(some)] = hilbert_key(grid)
    return out


def encoded(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, place (Hilbert key), n (ids with the end id) and ids (raw 16- or 32-bit) of every row."""
    path = vocabulary_path or vocabulary()

    def rows(batch):
        made = encoder(path)
        kind = "<u2" if made.size <= 1 << 16 else "<u4"
        found = made.encode_many(batch.column(1).to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        end, width = np.array([END_ID], kind).tobytes(), np.dtype(kind).itemsize
        data, ends = ids.astype(kind).tobytes(), (width * np.cumsum(lengths)).tolist()
        return {
            "doc_id": batch.column(0), "place": pa.array(curve_keys(ids, lengths)), "n": pa.array(lengths + 1),
            "ids": [data[a:b] + end for a, b in zip([0, *ends], ends)],
        }

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_batches(own, rows, "doc_id long, place long, n long, ids binary")


_PIECES = "part int, local long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long"


def pack(docs: DataFrame, length: int = LENGTH, vocabulary_path: str | None = None, keep_words: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in one piece; sequences are numbered from 0 without gaps, those of one range of the curve
    beside one another. All but a few sequences are full: at most one for each range is open, and open ones share
    sequences where they fit. Null and empty texts are documents of the end id alone. Repeated rows and rows with a null
    id are packed like any other. Extra columns are ignored. Without ``keep_words`` workers drop what they remember of the
    encoding once ids are written, so that other work finds more memory.
    """
    spark = docs.sparkSession
    path = vocabulary_path or vocabulary()
    wide = written(encoded(docs, path), "encoded")
    # the id and a hash of the ids take part in the order, so equal places (copies) still spread over ranges
    ordered = wide.withColumn("tie", F.xxhash64("doc_id", "ids")).repartitionByRange(default_parts(spark), "place", "doc_id", "tie")
    ordered = ordered.sortWithinPartitions("place", "doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "ids")

    def pieces(batches):
        kind = "<u2" if encoder(path).size <= 1 << 16 else "<u4"
        width = np.dtype(kind).itemsize
        filled = 0  # ids of this range so far
        for batch in slices(batches):
            out = {name.split()[0]: [] for name in _PIECES.split(", ")}
            data = batch.column(2).to_pylist()
            wide = memoryview(np.frombuffer(b"".join(data), kind).astype("<u4")).cast("B")
            after = 0
            for part, doc_id, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(len, data)):
                before, after = after, after + 4 * (size // width)
                ids = wide[before:after]
                n = len(ids) // 4
                at = 0
                while at < n:
                    offset = (filled + at) % length
                    size = min(length - offset, n - at)
                    for name, value in (
                        ("part", part), ("local", (filled + at) // length), ("doc_id", doc_id), ("start", at), ("length", size),
                        ("ids_crc32", zlib.crc32(ids[4 * at : 4 * (at + size)])), ("doc_tokens", n), ("offset", offset),
                    ):
                        out[name].append(value)
                    at += size
                filled += n
            if out["part"]:
                yield pa.RecordBatch.from_pydict(out, schema)
        if not keep_words:
            encoder(path).forget()
        give_back()

    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in _PIECES.split(", ")])
    shipped(spark)
    found = written(ordered.mapInArrow(pieces, _PIECES), "pieces")
    ranges = found.groupBy("part").agg(F.sum("length").alias("ids")).collect()  # one row per range
    plan = spark.createDataFrame(_joined(sorted((r["part"], r["ids"]) for r in ranges), length), "part int, base long, full long, tail_id long, tail_offset long")
    own = F.col("local") < F.col("full")
    return found.join(F.broadcast(plan), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(own, F.col("base") + F.col("local")).otherwise(F.col("tail_id")).alias("sequence_id"),
        F.when(own, F.col("offset")).otherwise(F.col("tail_offset") + F.col("offset")).alias("offset"),
    )


def _joined(ranges: list[tuple[int, int]], length: int) -> list[tuple]:
    """(part, first sequence, full sequences, sequence and offset of the open one) of each range, given their ids.

    Open sequences go, the largest first, into the shared sequence with the least room that is enough.
    """
    out, base, open_ = {}, 0, []
    for part, ids in ranges:
        out[part] = [part, base, ids // length, 0, 0]
        base += ids // length
        if ids % length:
            open_.append((ids % length, part))
    rooms: list[tuple[int, int]] = []  # (room, number) of shared sequences, in order
    shared = 0
    for size, part in sorted(open_, key=lambda x: (-x[0], x[1])):
        at = bisect.bisect_left(rooms, (size, -1))
        room, number = rooms.pop(at) if at < len(rooms) else (length, shared)
        shared = max(shared, number + 1)
        out[part][3:] = [base + number, length - room]
        if room > size:
            bisect.insort(rooms, (room - size, number))
    return [tuple(row) for row in out.values()]
