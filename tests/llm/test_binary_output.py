"""Token shards, packing and sharding: exact round trips."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftway.llm import packing, shards, token_index, tokens
from driftway.llm.common import work_folder
from driftway.llm.tokens import Encoder, vocabulary
from tests.llm.fixtures import FOLDER, docs, texts


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary())


def ids_of(plain, text):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_is_exact(plain):
    odd = [
        "", None, " ", "a", " a", "a ", "a  b", "x\n y", "x\ny", "don't 's 'S it's", "a b", "日本 語テ", "a\tb c", "٣ ² ½ x", "Ġ ĠĠ aĠ b",
        "x,. y", "_. a", "a.\nB,c\nD", ".a", "a\t.b", "1.2,3", "é. à, é. f", "don.'s ,x", "x\x01y z", "\nlead", "trail\n", "﻿a b",
        "<|endoftext|>", "a<|endoftext|>b", "one <|endoftext|> two, three.", "<|endoftext|><|endoftext|> x", "<|endoftext|", "a <|endo ftext|> b",
    ]
    made = Encoder(vocabulary())
    for _ in range(2):  # new words, then known ones
        for text, got in zip(odd, made.encode_many(odd)):
            assert got == ids_of(plain, text)[:-1].tobytes(), repr(text)


def test_encoder_with_little_memory(plain, monkeypatch):
    """Words move between two generations and are forgotten; ids stay what they are."""
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    made = Encoder(vocabulary())
    batches = [["one two three", "four five. six"], ["two seven eight, nine"], ["one ten"], ["three two eleven twelve"], ["one two three"]]
    for _ in range(3):
        for texts_ in batches:
            for text, got in zip(texts_, made.encode_many(texts_)):
                assert got == ids_of(plain, text)[:-1].tobytes()
            assert len(made.known) + len(made.older) < 20


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 1000, 20000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        made = token_index.PerfectHash.build(keys)
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_index.PerfectHash.build(np.array([5, 5]))


def test_token_shards(spark, plain):
    rows = texts()
    folder = work_folder(spark, "test-shards")
    found = token_index.indexed(docs(spark, rows), folder).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, text in order:
        ids = ids_of(plain, text)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    asked = [*range(0, 200), -5, None, 9]
    keys = spark.createDataFrame([(k,) for k in asked], "doc_id long")
    answers = {r["doc_id"]: r["ids"] for r in token_index.lookup(keys, folder).collect()}
    by_id = {}
    for i, text in order:
        by_id.setdefault(i, text)
    assert set(answers) == {i for i in by_id if i is not None}
    assert all(answers[i] == ids_of(plain, by_id[i]).tolist() for i in answers)
    assert token_index.indexed(docs(spark).limit(0)).count() == 0


def check_packing(found, rows, plain, length):
    pieces, places = {}, {}
    for r in found:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = []
    for i, text in rows:
        ids = ids_of(plain, text)
        assert (i, len(ids)) in pieces
        want.append(len(ids))
    for (i, n), own in pieces.items():
        same = sum(x == i and len(ids_of(plain, t)) == n for x, t in rows)
        assert sum(r["length"] for r in own) == n * same
        for text in {t or "" for x, t in rows if x == i and len(ids_of(plain, t)) == n}:
            ids = ids_of(plain, text)
            assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    for spans in places.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length
    assert sorted(places) == list(range(len(places)))
    return sum(want) / (length * len(places))


def test_packing(spark, plain):
    rows = texts()
    for length in (16, 1024):
        found = packing.pack(docs(spark, rows), length).collect()
        check_packing(found, rows, plain, length)
    assert packing.pack(docs(spark).limit(0)).count() == 0
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert check_packing(packing.pack(table).collect(), rows, plain, 1024) > 0.98


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 2), (4, 2)])
def test_hilbert_neighbours_touch(dimensions, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = packing.hilbert_key(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_open_sequences_share(spark):
    ranges = [(0, 2500), (1, 1024), (3, 30), (4, 900), (7, 60)]
    plan = {r[0]: r[1:] for r in packing._joined(ranges, 1024)}
    assert plan[0][:2] == (0, 2) and plan[1][:2] == (2, 1) and plan[3][:2] == (3, 0)
    used = {}
    for part, size in ((0, 452), (3, 30), (4, 900), (7, 60)):
        used.setdefault(plan[part][2], []).append((plan[part][3], size))
    assert sorted(used) == [3, 4]
    for spans in used.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 1024


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 200])
def test_shards(spark, bucket_bytes):
    rows = texts() + [(k, f"text {k}") for k in range(100, 400)]
    found = shards.placed(docs(spark, rows), 24, bucket_bytes).collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == want
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values()) and max(slots) <= 23
    again = shards.placed(docs(spark, rows[::-1]), 24, bucket_bytes).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)
    assert shards.placed(docs(spark).limit(0)).count() == 0


def test_fisher_yates_is_uniform():
    seen = np.zeros((5, 5))
    for seed in range(3000):
        seen[np.arange(5), shards.fisher_yates(5, seed, 0, 0)] += 1
    assert np.abs(seen / 3000 - 0.2).max() < 0.04


def test_rows_come_through_the_index(spark, plain):
    """Two records exchanged in the slot table change the result; a wrong fingerprint stops the reader."""
    import glob
    import json

    rows = [(i, f"text number {i} " * (1 + i % 5)) for i in range(40)] + [(7, "again"), (None, "no key")]
    folder = work_folder(spark, "test-index")
    token_index.write(docs(spark, rows).coalesce(1), folder)
    good = sorted(map(tuple, token_index.read(spark, folder).collect()), key=repr)
    path = max(glob.glob(f"{folder.removeprefix('file://')}/*.idx"), key=lambda p: len(open(p, "rb").read()))
    data = open(path, "rb").read()
    line_end = data.index(b"\n", 8)
    head, at, places = json.loads(data[8:line_end]), line_end + 1, {}
    for name, kind, length in head["arrays"]:
        places[name] = (at, kind, length)
        at += np.dtype(kind).itemsize * length
    for name in ("records", "fingerprints"):
        at, kind, length = places[name]
        values = np.frombuffer(data, kind, length, at).copy()
        assert length > 1
        values[[0, 1]] = values[[1, 0]]
        size = values.nbytes
        with open(path, "wb") as out:
            out.write(data[:at] + values.tobytes() + data[at + size :])
        if name == "records":
            try:
                changed = sorted(map(tuple, token_index.read(spark, folder).collect()), key=repr)
            except Exception as error:  # the repeated key was one of the two
                assert "leads to a record twice" in str(error)
            else:
                assert changed != good and [r[0] for r in changed] == [r[0] for r in good]
        else:
            with pytest.raises(Exception, match="does not know 2 of its keys"):
                token_index.read(spark, folder).collect()


def test_copies_of_a_record_fill_many_buckets(spark):
    rows = [(None, "the same text")] * 2000 + [(i, f"text {i}") for i in range(2000)]
    own = docs(spark, rows)
    dealt = shards.scatter(own, shards=4, bucket_bytes=2000)
    buckets = dealt.groupBy("shard", "bucket").agg({"size": "sum"}).collect()
    assert sum(r[2] for r in buckets) == sum(len(t) + 8 for _, t in rows)
    hot = dealt.filter("doc_id IS NULL").groupBy("shard", "bucket").count().collect()
    assert len({r["shard"] for r in hot}) == 1  # the id alone decides the shard
    number = dealt.agg({"bucket": "max"}).first()[0] + 1
    assert len(hot) == number and max(r["count"] for r in hot) < 2 * 2000 / number
    placed = shards.placed(own, shards=4, bucket_bytes=2000)
    assert placed.count() == 4000 and placed.select("shard", "slot").distinct().count() == 4000


def test_packing_that_forgets_its_words_gives_the_same_pieces(spark):
    encoder = tokens.Encoder(tokens.vocabulary())
    texts = ["some words, some more words.", "words again", None]
    first = encoder.encode_many(texts)
    assert encoder.known
    encoder.forget()
    assert not encoder.known and not encoder.older
    assert encoder.encode_many(texts) == first
    own = spark.createDataFrame([(k, f"text {k} " * (k % 90)) for k in range(60)], "doc_id long, text string")
    kept, forgotten = ({tuple(r) for r in packing.pack(own, keep_words=k).collect()} for k in (True, False))
    assert kept == forgotten and len(kept) >= 60
