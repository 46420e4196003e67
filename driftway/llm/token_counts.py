"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both sides agree.

A byte-level vocabulary splits a text from left to right into words by a pattern that looks forward only, and merges inside
words. So what follows the start of a word depends on the text from there on alone. A chunk that begins at the start of the
text, or at a proven word start, has the text's own words up to shortly before its end. The next chunk begins anywhere; from
the first place on where it starts a word together with the chunk before, it has the text's own words, too. Such a common
start inside the overlap is a proven border: tokens of the one chunk count up to it, those of the next from it on. Where an
overlap has none (one endless word, say), the text is encoded again with wider overlaps, at last as a whole.

Chunks of one text are rows of their own, so a huge text is spread over tasks and no task holds its tokens.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import default_parts, map_batches, shipped, slices, written
from driftway.llm.tokens import encoder, vocabulary
from driftway.session import broadcast_if_small

#: Code points of a chunk and of the overlap of neighbours; texts longer than LONG are cut. Overlaps grow by WIDER.
CHUNK, OVERLAP, LONG, WIDER = 32_768, 512, 65_536, 4
LIMIT = 1024


class Vocabulary:
    """A public vocabulary with what is known of its words."""

    def __init__(self, path: str):
        self.path, self.forward = path, False
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.pieces = None
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        words, named = parts.get("pre_tokenizer") or {}, parts.get("added_tokens") or []
        #: True where the splice is proven: words by the forward pattern, and no step that changes the text or its ends.
        self.forward = (
            words.get("type") == "ByteLevel" and bool(words.get("use_regex", True)) and not words.get("add_prefix_space")
            and not parts.get("normalizer") and not parts.get("post_processor") and not parts["model"].get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in named)
        )
        # a word start this far before the end of a chunk can't lie in a special token's name or depend on what comes after
        self.guard = max([len(t["content"]) for t in named], default=0) + 4

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of whole texts, none for null."""
        if self.forward:
            return [len(found) // 4 for found in encoder(self.path).encode_many(texts)]
        texts = [text or "" for text in texts]
        if self.pieces is not None:
            return [len(found) for found in self.pieces.encode(texts, num_threads=1)]
        return [len(found.ids) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_starts(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """Number of tokens, and (place, tokens before it) of each word start."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        before, starts = None, []
        for at, (word, (place, _)) in enumerate(zip(found.word_ids, found.offsets)):
            if word != before:
                starts.append((place, at))
                before = word
        return len(found.ids), starts


_KNOWN: dict[str, Vocabulary] = {}


def known(path: str) -> Vocabulary:
    """One vocabulary for all tasks of a worker."""
    if path not in _KNOWN:
        _KNOWN[path] = Vocabulary(path)
    return _KNOWN[path]


def chunk_starts(length: int, chunk: int, overlap: int) -> list[int]:
    """Where the chunks of a text begin; each but the last has ``chunk`` code points, the last more than an overlap."""
    stride = chunk - overlap
    return [stride * k for k in range(1 if length <= chunk else -(-(length - overlap) // stride))]


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, chunk number, number of chunks, first place and piece of every chunk of (key, text)."""
    names = ["key", "k", "chunks", "start", "piece"]

    def cut(batches):
        for batch in slices(batches, 1):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = chunk_starts(len(text), chunk, overlap)
                for k, start in enumerate(starts):
                    row = [key], [k], [len(starts)], [start], [text[start : start + chunk]]
                    kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(row, kinds)], names=names)

    shipped(texts.sparkSession)
    return texts.select("key", "text").mapInArrow(cut, "key string, k long, chunks long, start long, piece string")


_STARTS = "key string, chunks long, joint long, place long, value long"


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """key and n_tokens of each text of (key, text); null where an overlap has no common word start.

    Joint k lies between chunks k and k + 1. There each common start has the tokens before it in the one chunk less those
    before it in the next; these differences of all joints and the tokens of the last chunk add up to those of the text.
    """
    pieces = _chunks(texts, chunk, overlap)
    pieces = pieces.repartition(2 * default_parts(texts.sparkSession), "key", "k")

    def encode(batches):
        made = known(path)
        for batch in slices(batches, 16):
            out = {name.split()[0]: [] for name in _STARTS.split(", ")}
            for key, k, chunks, start, piece in zip(*(batch.column(c).to_pylist() for c in range(5))):
                tokens, starts = made.word_starts(piece)
                rows = []
                if k:
                    rows += [(k - 1, start + place, -before) for place, before in starts if place <= overlap]
                if k + 1 < chunks:
                    low, high = len(piece) - overlap, len(piece) - made.guard
                    rows += [(k, start + place, before) for place, before in starts if low <= place <= high]
                else:
                    rows.append((k, -1, tokens))
                for row in rows:
                    for name, value in zip(out, (key, chunks, *row)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _STARTS.split(", ")])
    common = (
        pieces.mapInArrow(encode, _STARTS).groupBy("key", "chunks", "joint", "place")
        .agg(F.sum("value").alias("value"), F.count("*").alias("sides"))
    )
    taken = F.max_by("value", F.when((F.col("sides") == 2) | (F.col("place") < 0), F.col("place")))
    joints = common.groupBy("key", "chunks", "joint").agg(taken.alias("value"))
    return joints.groupBy("key").agg(
        F.when(F.count("value") == F.max("chunks"), F.sum("value")).alias("n_tokens")
    )


def long_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key and n_tokens of distinct texts (key, text) of any length, by chunks; overlaps widen until all are aligned."""
    done, pending = None, texts
    while True:
        found = written(_spliced(pending, path, chunk, overlap), "spliced")
        good = found.filter("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        failed = found.filter("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            return done
        pending = pending.join(failed, "key", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)


def count(
    docs: DataFrame, vocabulary_path: str | None = None, limit: int = LIMIT, long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Tokens are those that the vocabulary's library gives for the whole text: none added, nothing cut, names of special
    tokens as its default has them. Texts of more than ``long`` code points go through chunks, equal ones once; a
    vocabulary for which common word starts prove nothing has all its texts encoded whole. Null and empty texts have no
    bytes and no tokens. Repeated rows and rows with a null id stay; extra columns are ignored; an empty table gives none.
    """
    if not 0 < 2 * overlap < chunk:
        raise ValueError("a chunk must be longer than two overlaps.")
    path = vocabulary_path or vocabulary()
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("n_bytes"),
        docs["text"].alias("text"),
    )
    is_long = F.coalesce(F.char_length("text") > long, F.lit(False)) if known(path).forward else F.lit(False)

    def rows(batch):
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1), "n_tokens": known(path).counts(batch.column(2).to_pylist())}

    counted = map_batches(own.filter(~is_long), rows, "doc_id long, n_bytes long, n_tokens long")
    if known(path).forward:
        keyed = own.filter(is_long).withColumn("key", F.sha2("text", 256))
        texts = written(keyed.groupBy("key").agg(F.first("text").alias("text")), "long-texts")
        found = broadcast_if_small(long_counts(texts, path, chunk, overlap))
        counted = counted.unionByName(keyed.select("doc_id", "n_bytes", "key").join(found, "key").drop("key"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
