"""Document fingerprints by I-Match with randomised lexicons.

Terms are the lower-cased words of a text. The lexicon holds the terms whose document frequency lies in a band, that is
whose inverse document frequency is neither too low nor too high. A document keeps its lexicon terms, distinct and sorted,
and hashes them once for each of several random subsets of the lexicon. Subsets come in levels, each level half as large
as the one before, so that texts of any length meet subsets in which they keep just a few terms; an edit changes few of
those hashes. A subset without a term of the document has the hash 0.

The likeness of two fingerprints is taken at the level that tells most: the densest one where either document still has a
small number of terms in a subset, and is the share of equal hashes among the subsets that are empty in neither or one.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import cut_points, default_parts, lower_words, part_of, shipped, slices

#: The band: a term is kept if its documents are at least LOW and at most HIGH of all. No more than (mean number of
#: distinct terms of a document) / LOW terms can reach LOW, whatever the size of the corpus: this bounds the lexicon.
LOW, HIGH = 1 / 2500, 1 / 20
LEVELS, SUBSETS = 11, 12
SEED = 31
#: The most terms per subset, on average, of the level at which fingerprints are compared.
FEW = 1.5
_SALTS = np.random.default_rng(SEED).integers(1, 1 << 63, SUBSETS, dtype=np.uint64) | np.uint64(1)


def term_hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of the terms of a text, sorted."""
    digest = xxhash.xxh3_64_intdigest
    return np.sort(np.fromiter((digest(word) for word in set(lower_words(text))), np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def fingerprint(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """LEVELS x SUBSETS hashes of 16 bits. Without any lexicon term all terms count, so that rare texts stay apart."""
    kept = terms
    if len(lexicon) and len(terms):
        at = np.searchsorted(lexicon, terms)
        at[at == len(lexicon)] = 0
        inside = lexicon[at] == terms
        if inside.any():
            kept = terms[inside]
    out = np.zeros((LEVELS, SUBSETS), np.uint16)
    if not len(kept):
        return out
    drawn = _mix(kept[None, :] * _SALTS[:, None])
    values = _mix(drawn)
    for level in range(LEVELS):
        # a term is in the subset of level k if the first k bits of its draw are zero
        inside = drawn < np.uint64(1 << (64 - level)) if level else np.ones_like(drawn, bool)
        filled = inside.any(axis=1)
        if not filled.any():
            break
        # terms are distinct, so a sum of their hashes is a hash of the sorted set, whatever the order of adding
        sums = np.where(inside, values, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        hashed = (_mix(sums) >> np.uint64(48)).astype(np.uint16)
        out[level] = np.where(filled, np.maximum(hashed, 1), 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; equal fingerprints have 1."""
    if np.array_equal(a, b):
        return 1.0
    # with m terms per subset on average, a share of exp(-m) of the subsets is empty; sparser levels add to the first one
    # where few terms are left, as just a few of its subsets may be filled
    sparse = np.minimum((a == 0).mean(axis=1), (b == 0).mean(axis=1)) >= np.exp(-FEW)
    first = int(np.argmax(sparse)) if sparse.any() else LEVELS - 1
    here, there = a[first:], b[first:]
    filled = (here > 0) | (there > 0)
    return float(((here == there) & filled).sum() / filled.sum()) if filled.any() else 0.0


def lexicon_of(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band, from the document frequencies over all rows of ``docs``."""
    total = docs.count()

    def frequencies(batches):
        counted: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counted.update(set(lower_words(text)))
            if len(counted) > 300_000:
                yield _counted(counted)
                counted = Counter()
        if counted:
            yield _counted(counted)

    def _counted(counted):
        digest = xxhash.xxh3_64_intdigest
        terms = np.fromiter(map(digest, counted), np.uint64, len(counted)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(list(counted.values()), pa.int64())], names=["term", "n"])

    shipped(docs.sparkSession)
    found = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = found.filter((F.col("n") >= low * total) & (F.col("n") <= high * total)).select("term")
    return np.sort(band.toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double"
)


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the text replaced by the first as many characters, or all, of the next one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row, of its edited text, and their likeness; rows are followed in ascending doc_id.

    The last row is followed by the first one. Null texts are empty texts; fingerprints of empty texts are all zeros and
    equal. Rows that repeat an id follow one another ordered by text; rows with a null id come last. A single row
    follows itself. Extra columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = spark.sparkContext.broadcast(lexicon_of(own))
    cuts = cut_points(own, "doc_id", default_parts(spark))
    dealt = own.withColumn("part", part_of(F.col("doc_id"), cuts))
    # each range also gets the row that follows its last one: the first row of the next range that has rows
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()  # one row per range
    ranges = [row["part"] for row in firsts]
    before = {row["first"]: ranges[k - 1] for k, row in enumerate(firsts)}
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    return _followed(dealt, before, len(cuts) + 1, held)


def _followed(dealt: DataFrame, before: dict, parts: int, held) -> DataFrame:
    firsts = dealt.sparkSession.createDataFrame(list(before.items()), "first long, target int")  # one row per range
    rows = dealt.select("part", F.lit(0).alias("guest"), "doc_id", "text")
    guests = dealt.join(F.broadcast(firsts), dealt["doc_id"].eqNullSafe(firsts["first"])).select(
        F.col("target").alias("part"), F.lit(1).alias("guest"), "doc_id", "text"
    )
    ordered = rows.unionByName(guests).repartitionById(parts, F.col("part")).sortWithinPartitions(
        "part", "guest", F.col("doc_id").asc_nulls_last(), "text"
    )

    def compared(batches):
        lexicon = held.value
        last = None
        for batch in slices(batches):
            out = {name.split()[0]: [] for name in SCHEMA.split(", ")}
            for guest, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if last is None or not last["done"]:
                    mine = fingerprint(term_hashes(text), lexicon)
                    if last is not None:
                        _pair(out, last, text, mine, lexicon)
                    last = {"doc_id": doc_id, "text": text, "mark": mine, "done": bool(guest)}
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, schema)

    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in SCHEMA.split(", ")])
    shipped(dealt.sparkSession)
    return ordered.select("part", "guest", "doc_id", "text").mapInArrow(compared, SCHEMA)


def _pair(out: dict, row: dict, following: str, mark: np.ndarray, lexicon: np.ndarray) -> None:
    changed = edited(row["text"], following)
    other = fingerprint(term_hashes(changed), lexicon)
    for name, value in (
        ("doc_id", row["doc_id"]), ("n_chars", len(row["text"])), ("edited_sha256", hashlib.sha256(changed.encode()).hexdigest()),
        ("fingerprint", row["mark"].astype(">u2").tobytes().hex()), ("edited_fingerprint", other.astype(">u2").tobytes().hex()),
        ("near_edited", likeness(row["mark"], other)), ("near_next", likeness(row["mark"], mark)),
    ):
        out[name].append(value)
