"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files below one folder:

``<name>.ids``   the raw ids of its documents one after the other, little-endian unsigned 16-bit integers where the
                 vocabulary allows it, else 32-bit.
``<name>.idx``   the text ``TOKIDX1\\n``, a line of JSON (counts, and name, type and length of each array), and the arrays:
                 keys and token offsets of the records, and the index from keys to records: the bit levels of a minimal
                 perfect hash with the ranks of their words, and for each slot the record and a fingerprint of its key.

Keys are document ids in ascending order over the shards; ``manifest.json`` names the shards with their first and last
key and the number of tokens before them. A key is looked up in constant time: a bit for each level until one is set, its
rank is the slot, the fingerprint tells keys that are not there (all but about one in four billion), and the record has
the offset of the ids.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftway.llm.common import cut_points, default_parts, part_of, shipped, slices, work_folder
from driftway.llm.tokens import encoder, vocabulary

#: Rows that a shard should hold at most; more rows take more shards.
ROWS_PER_SHARD = 50_000
#: Bits for each key of a level of the hash; levels after which building gives up.
GAMMA, MOST_LEVELS = 2.0, 64
END_ID = 0
_MAGIC = b"TOKIDX1\n"
_READ_TOKENS = 1 << 20


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of each key, another one for each salt."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: level by level, keys alone at their bit keep it."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes = sizes
        self.words = words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys.astype(np.uint64)
        while len(left):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys are not distinct.")
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.empty(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or some slot, for keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = self.starts[level] + (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, shift = bit // 64, (bit % 64).astype(np.uint64)
            is_set = (self.words[word] >> shift) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << shift) - np.uint64(1))
            rank = self.ranks[word] + np.bitwise_count(below)
            out[open_[is_set]] = rank[is_set]
            open_ = open_[~is_set]
        return out


class Shard:
    """A shard read back: records in key order, and constant-time lookup by key."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        with filesystem.open_input_file(path + ".idx") as file:
            data = file.read()
        if not data.startswith(_MAGIC):
            raise ValueError(f"{path}.idx is not an index.")
        line_end = data.index(b"\n", len(_MAGIC))
        head = json.loads(data[len(_MAGIC) : line_end])
        at, arrays = line_end + 1, {}
        for name, kind, length in head["arrays"]:
            arrays[name] = np.frombuffer(data, kind, length, at)
            at += arrays[name].nbytes
        self.filesystem, self.path, self.id_type = filesystem, path, np.dtype(head["id_type"])
        self.keys, self.offsets, self.keyed = arrays["keys"], arrays["offsets"], int(head["keyed"])
        self.hash = PerfectHash(head["levels"], arrays["bits"])
        self.records, self.fingerprints = arrays["records"], arrays["fingerprints"]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, or -1."""
        slots = self.hash.slots(keys)
        found = slots >= 0
        found[found] = self.fingerprints[slots[found]] == _fingerprint(keys[found])
        return np.where(found, self.records[np.where(found, slots, 0)] if len(self.records) else -1, -1)

    def reached(self, name: str = "the shard") -> tuple[np.ndarray, np.ndarray]:
        """Records and keys: those that the index leads to from each key, in record order, then the records without a key.

        The slot of a key has its first record; further records of a repeated key follow that one. A key whose slot has
        another fingerprint, or that leads to a record twice, is an error.
        """
        keys, counts = np.unique(self.keys, return_counts=True)
        first = self.find(keys)
        if (first < 0).any():
            raise ValueError(f"the index of {name} does not know {int((first < 0).sum())} of its keys.")
        before = np.cumsum(counts) - counts
        held = np.repeat(first - before, counts) + np.arange(int(counts.sum()))
        order = np.argsort(held, kind="stable")
        held = held[order]
        if len(held) and (held[-1] >= self.keyed or (np.diff(held) == 0).any()):
            raise ValueError(f"the index of {name} leads to a record twice, or to none.")
        return np.concatenate([held, np.arange(self.keyed, len(self.offsets) - 1)]), np.repeat(keys, counts)[order]

    def payloads(self, first: int, last: int):
        """(record, ids as 32-bit little-endian bytes) for records first to last - 1, read in runs."""
        width = self.id_type.itemsize
        with self.filesystem.open_input_file(self.path + ".ids") as file:
            at = first
            while at < last:
                end = int(np.searchsorted(self.offsets, self.offsets[at] + _READ_TOKENS, side="right")) - 1
                end = min(max(end, at + 1), last)
                base = int(self.offsets[at])
                file.seek(base * width)
                data = np.frombuffer(file.read((int(self.offsets[end]) - base) * width), self.id_type)
                for record in range(at, end):
                    yield record, data[self.offsets[record] - base : self.offsets[record + 1] - base].astype("<u4").tobytes()
                at = end


def _write_index(stream, keys: list[int | None], lengths: list[int], id_type: str) -> None:
    """The index file of records with these keys (null ones last) and numbers of ids."""
    keyed = sum(key is not None for key in keys)
    known = np.array(keys[:keyed], np.int64)
    distinct, first = np.unique(known, return_index=True)
    hashed = PerfectHash.build(distinct)
    slots = hashed.slots(distinct)
    records, fingerprints = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.uint32)
    records[slots], fingerprints[slots] = first, _fingerprint(distinct)
    arrays = {
        "keys": known, "offsets": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), "bits": hashed.words,
        "records": records, "fingerprints": fingerprints,
    }
    head = {
        "id_type": id_type, "keyed": keyed, "records": len(keys), "levels": hashed.sizes,
        "arrays": [[name, values.dtype.str, len(values)] for name, values in arrays.items()],
    }
    stream.write(_MAGIC + json.dumps(head).encode() + b"\n")
    for values in arrays.values():
        stream.write(values.tobytes())


def write(docs: DataFrame, folder: str, vocabulary_path: str | None = None) -> list[dict]:
    """Writes shards and manifest of all ``docs`` (doc_id, text) below ``folder``, in ascending order of doc_id.

    Null and empty texts have the end id alone. Rows that repeat an id stay beside one another, ordered by text; the
    index leads to the first. Rows with a null id come last and have no key. Every task writes under names of its own and
    tells them in its result, so a repeated task does no harm: files of lost attempts are not in the manifest.
    """
    spark = docs.sparkSession
    path = vocabulary_path or vocabulary()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    parts = max(default_parts(spark), -(-own.count() // ROWS_PER_SHARD))
    cuts = cut_points(own, "doc_id", parts)
    dealt = (
        own.withColumn("part", part_of(F.col("doc_id"), cuts))
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "text")
    )

    def shard(batches):
        made = encoder(path)
        id_type = "<u2" if made.size <= 1 << 16 else "<u4"
        filesystem, root = fs.FileSystem.from_uri(folder)
        end = np.array([END_ID], "<u4").tobytes()
        name, part, file, keys, lengths = "", None, None, [], []
        try:
            for batch in slices(batches):
                if not batch.num_rows:
                    continue
                if file is None:
                    part = batch.column("part")[0].as_py()
                    name = f"shard-{part:06d}-{uuid.uuid4().hex[:12]}"
                    filesystem.create_dir(root, recursive=True)
                    file = filesystem.open_output_stream(f"{root}/{name}.ids")
                ids = [found + end for found in made.encode_many(batch.column("text").to_pylist())]
                file.write(np.frombuffer(b"".join(ids), "<u4").astype(id_type).tobytes())
                keys += batch.column("doc_id").to_pylist()
                lengths += [len(found) // 4 for found in ids]
        finally:
            if file is not None:
                file.close()
        if file is not None:
            head = io.BytesIO()
            _write_index(head, keys, lengths, id_type)
            with filesystem.open_output_stream(f"{root}/{name}.idx") as stream:
                stream.write(head.getvalue())
            known = [key for key in keys if key is not None]
            yield pa.RecordBatch.from_pylist([{
                "part": part, "name": name, "records": len(keys), "tokens": sum(lengths),
                "first": known[0] if known else None, "last": known[-1] if known else None,
            }], pa.schema([("part", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    shipped(spark)
    done = dealt.mapInArrow(shard, "part int, name string, records long, tokens long, first long, last long").collect()
    shards, before = [], 0
    for row in sorted(done, key=lambda r: r["part"]):
        shards.append({"name": row["name"], "records": row["records"], "tokens": row["tokens"], "first": row["first"], "last": row["last"], "start": before})
        before += row["tokens"]
    filesystem, root = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)
    with filesystem.open_output_stream(f"{root}/manifest.json") as stream:
        stream.write(json.dumps({"vocabulary": path, "shards": shards}).encode())
    return shards


def manifest(folder: str) -> list[dict]:
    filesystem, root = fs.FileSystem.from_uri(folder)
    with filesystem.open_input_stream(f"{root}/manifest.json") as stream:
        return json.loads(stream.read())["shards"]


def _shard_rows(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """One row per shard, each in a partition of its own."""
    rows = [(k, s["name"], s["start"]) for k, s in enumerate(shards)]
    table = spark.createDataFrame(rows, "part int, name string, start long")
    return table.repartitionById(max(1, len(rows)), F.col("part"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, read back from the files shard by shard.

    Every record with a key is reached through the index: the slot of its key tells fingerprint and first record, and the
    ids are those at that record's offset. Only records without a key are read by their place alone. An empty folder
    gives no rows.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def records(batches):
        filesystem, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(filesystem, f"{root}/{row['name']}")
                held, found = shard.reached(row["name"])
                n = len(held)
                crcs = np.empty(n, np.int64)
                # what the index led to, in the order of the file, in runs of neighbours
                for run in np.split(np.arange(n), np.flatnonzero(np.diff(held) != 1) + 1) if n else []:
                    first = int(held[run[0]])
                    crcs[run] = [zlib.crc32(ids) for _, ids in shard.payloads(first, first + len(run))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([*found.tolist(), *[None] * (n - len(found))], pa.int64()),
                    pa.array(row["start"] + shard.offsets[held]), pa.array(shard.offsets[held + 1] - shard.offsets[held]), pa.array(crcs),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shipped(spark)
    return _shard_rows(spark, manifest(folder)).mapInArrow(records, schema)


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """doc_id and ids (array of long) of the first record of each key of ``keys`` (doc_id) that is in the shards.

    Keys go to their shard by its first key; a key repeated in the request is answered each time.
    """
    shards = [s for s in manifest(folder) if s["first"] is not None]
    cuts = [s["first"] for s in shards[1:]]
    # rows of one id may run over from the shard before; the first record is in the first shard whose last key reaches it
    cuts = [max(low, shards[k]["last"] + 1) for k, low in enumerate(cuts)]
    names = [s["name"] for s in shards]
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    dealt = asked.withColumn("part", part_of(F.col("doc_id"), cuts)).repartition("part").sortWithinPartitions("part")

    def answer(batches):
        filesystem, root = fs.FileSystem.from_uri(folder)
        opened, shard = None, None
        for batch in slices(batches):
            parts, values = batch.column("part").to_numpy(), batch.column("doc_id").to_numpy()
            for part in np.unique(parts):
                if opened != part:
                    opened, shard = part, Shard(filesystem, f"{root}/{names[part]}")
                wanted = values[parts == part]
                found = shard.find(wanted)
                ids = [np.frombuffer(next(shard.payloads(r, r + 1))[1], "<u4") for r in found[found >= 0].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted[found >= 0]), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], names=["doc_id", "ids"]
                )

    shipped(keys.sparkSession)
    if not names:
        return keys.sparkSession.createDataFrame([], "doc_id long, ids array<long>")
    return dealt.mapInArrow(answer, "doc_id long, ids array<long>")


def indexed(docs: DataFrame, folder: str | None = None, vocabulary_path: str | None = None) -> DataFrame:
    """Writes all documents and returns what the files hold: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or work_folder(docs.sparkSession, "token-shards")
    write(docs, folder, vocabulary_path)
    return read(docs.sparkSession, folder)
