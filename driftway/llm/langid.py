"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters: their vectors, each permuted (rotated) by its
place, are multiplied. A text bundles its n-grams: their vectors are added. A language's prototype bundles all n-grams of
its training texts, and a text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import give_back, held_out, keep_batches, map_batches, shipped, slices

DIMENSIONS = 512
N = 3
SEED = 23
UNKNOWN = "und"
#: Symbols of the alphabet: 0 between words, 1 to 26 for a to z, the others shared by all further letters.
SYMBOLS = 44
#: n-gram vectors that a worker keeps; beyond them it starts anew.
KEPT_GRAMS = 60_000


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (2 * rng.integers(0, 2, (SYMBOLS, dimensions)) - 1).astype(np.float32)


def gram_vectors(grams: np.ndarray, letters: np.ndarray, n: int = N) -> np.ndarray:
    """The bound vectors of n-gram ids (base SYMBOLS, first letter highest)."""
    bound = np.ones((len(grams), letters.shape[1]), np.float32)
    for place in range(n):
        symbol = grams // SYMBOLS ** (n - 1 - place) % SYMBOLS
        bound *= np.roll(letters, n - 1 - place, axis=1)[symbol]
    return bound


def _symbol_table() -> np.ndarray:
    """The symbol of every code point below 0x3000: letters have one, all else stands between words."""
    out = np.zeros(0x3000, np.int32)
    for point in range(len(out)):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            base = ord(low[0])
            out[point] = base - 96 if 97 <= base <= 122 else 27 + base * 7 % (SYMBOLS - 27)
    return out


_TABLE = _symbol_table()


def gram_counts(text: str | None, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ids, counts) over the whole text with words set apart; empty where no letter occurs."""
    empty = np.empty(0, np.int64)
    if not text:
        return empty, empty
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if points.max() < len(_TABLE):
        symbols = _TABLE[points]
    else:
        far = points >= len(_TABLE)
        symbols = _TABLE[np.where(far, 0, points)]
        for at in np.flatnonzero(far).tolist():
            if chr(points[at]).isalpha():
                symbols[at] = 27 + int(points[at]) * 7 % (SYMBOLS - 27)
    if not symbols.any():
        return empty, empty
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)  # one mark between words
    symbols = np.concatenate([[0], symbols[keep], [0]])
    grams = symbols[: len(symbols) - n + 1].astype(np.int64)
    for place in range(1, n):
        grams = grams * SYMBOLS + symbols[place : len(symbols) - n + 1 + place]
    counts = np.bincount(grams, minlength=1)
    found = np.flatnonzero(counts)
    return found, counts[found]


class Bundler:
    """Bundles counted n-grams; keeps the vectors of n-grams that it has met."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED, n: int = N):
        self.n = n
        self.letters = letter_vectors(dimensions, seed)
        self._clear()

    def _clear(self) -> None:
        self.place = np.full(SYMBOLS**self.n, -1, np.int32)
        self.vectors = np.empty((1024, self.letters.shape[1]), np.float32)
        self.used = 0

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of counts times vectors; whole numbers, so the order of adding does not matter."""
        new = grams[self.place[grams] < 0]
        if len(new):
            if self.used and self.used + len(new) > KEPT_GRAMS:
                self._clear()
                new = grams
            while self.used + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            self.vectors[self.used : self.used + len(new)] = gram_vectors(new, self.letters, self.n)
            self.place[new] = np.arange(self.used, self.used + len(new), dtype=np.int32)
            self.used += len(new)
        weights = counts.astype(np.float32)
        if counts.sum() >= 1 << 24:  # beyond what float32 adds exactly
            return counts.astype(np.float64) @ self.vectors[self.place[grams]].astype(np.float64)
        return (weights @ self.vectors[self.place[grams]]).astype(np.float64)


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # unit rows
    dimensions: int
    seed: int

    def bundler(self) -> Bundler:
        return Bundler(self.dimensions, self.seed)

    def predict(self, bundler: Bundler, text: str | None) -> tuple[str, float]:
        return self.judge(bundler, text)[:2]

    def judge(self, bundler: Bundler, text: str | None) -> tuple[str, float, int]:
        """The language, its cosine and the length class of the text: the whole part of log2 of its n-grams."""
        grams, counts = gram_counts(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0, 0
        bundled = bundler.bundle(grams, counts)
        norm = float(np.sqrt(bundled @ bundled))
        size = int(counts.sum()).bit_length() - 1
        if norm == 0:
            return UNKNOWN, 0.0, size
        cosines = self.prototypes @ bundled / norm
        best = int(np.argmax(np.round(cosines, 12)))  # the first name, on ties
        return self.languages[best], float(min(1.0, max(0.0, cosines[best]))), size


def train(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Prototypes of all languages named in ``lang``, from every row with text and language that is not held out.

    Each task counts n-grams by language and bundles the counts into one vector; vectors are added by language and place,
    so what is gathered is the number of languages times the number of dimensions.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def bundles(batches):
        counted: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, counts = gram_counts(text)
                if len(grams):
                    if lang not in counted:
                        counted[lang] = np.zeros(SYMBOLS**N, np.int64)
                    counted[lang][grams] += counts
        letters = letter_vectors(dimensions, seed)
        for lang, counts in sorted(counted.items()):
            total = np.zeros(dimensions)
            found = np.flatnonzero(counts)
            for start in range(0, len(found), 4096):
                some = found[start : start + 4096]
                total += counts[some].astype(np.float64) @ gram_vectors(some, letters).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(total.astype(np.int64))],
                names=["lang", "place", "value"],
            )

    shipped(docs.sparkSession)
    sums = known.select("lang", "text").mapInArrow(bundles, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = sums.collect()
    languages = sorted({row["lang"] for row in rows})
    prototypes = np.zeros((len(languages), dimensions))
    at = {lang: k for k, lang in enumerate(languages)}
    for row in rows:
        prototypes[at[row["lang"]], row["place"]] = row["value"]
    norms = np.sqrt(np.square(prototypes).sum(axis=1, keepdims=True))
    return Profiles(languages, prototypes / np.where(norms > 0, norms, 1), dimensions, seed)


_BUNDLERS: dict[tuple, Bundler] = {}


def _bundler(profiles: Profiles) -> Bundler:
    """One bundler for all tasks of a worker: it depends on the seed and the dimensions alone."""
    key = (profiles.dimensions, profiles.seed)
    if key not in _BUNDLERS:
        _BUNDLERS[key] = profiles.bundler()
    return _BUNDLERS[key]


def predict(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine with the winning prototype, at least 0) of every row.

    Only the text enters a prediction. Texts that are null or have no letter, and all texts where no language could be
    learned, get ``und`` and score 0. Repeated rows stay; a null id is not held out; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles or train(docs))

    def rows(batch):
        bundler = _bundler(held.value)
        found = [held.value.predict(bundler, text) for text in batch.column(2).to_pylist()]
        return {
            "doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [lang for lang, _ in found],
            "score": [score for _, score in found],
        }

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    return map_batches(own, rows, "doc_id long, held_out boolean, lang_pred string, score double")


#: No bound lies below this cosine: four standard deviations of that of unrelated bundles.
LEAST_COSINE = 4 / DIMENSIONS**0.5
#: Held-out texts of a language and length class from which it has a bound of its own.
LEAST_TEXTS = 20
#: A bound lies so many times the distance from the median to the lower quartile below the median: 3.4 standard
#: deviations of a normal sample. Up to a quarter of mislabelled or broken texts hardly moves it.
QUARTILES = 5


def bounds(docs: DataFrame, profiles: Profiles, least: float = LEAST_COSINE) -> dict[tuple[str, int], float]:
    """The least cosine of each language and length class, from held-out texts that are given their own language."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & held_out(F.col("doc_id")))

    def rows(batch):
        found = [held.value.judge(_bundler(held.value), text) for text in batch.column(1).to_pylist()]
        own = [lang == name for lang, (name, _, _) in zip(batch.column(0).to_pylist(), found)]
        return {"lang": batch.column(0), "own": own, "score": [f[1] for f in found], "size": [f[2] for f in found]}

    judged = map_batches(known.select("lang", "text"), rows, "lang string, own boolean, score double, size int").filter("own")
    cuts = judged.groupBy("lang", "size").agg(F.count("*").alias("n"), F.percentile_approx("score", [0.25, 0.5], 10_000).alias("q"))
    found = {}
    for row in cuts.filter(F.col("n") >= LEAST_TEXTS).collect():
        low, middle = row["q"]
        found[row["lang"], row["size"]] = max(least, middle - QUARTILES * (middle - low))
    give_back()  # the driver, too, lives on
    return found


def bound_of(found: dict[tuple[str, int], float], lang: str, size: int, least: float = LEAST_COSINE) -> float:
    """The bound of the length class or, where it has none, of the nearest shorter one that has."""
    return next((found[lang, k] for k in range(size, -1, -1) if (lang, k) in found), least)


def accepted(docs: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """The rows of ``docs`` that are in one of the learned languages, with their own columns.

    A text is in its nearest language when its cosine reaches what held-out texts of this language and of its length have.
    """
    profiles = train(docs)
    held = docs.sparkSession.sparkContext.broadcast((profiles, bounds(docs, profiles, least)))

    def keep(texts):
        own, found = held.value
        judged = [own.judge(_bundler(own), text) for text in texts]
        return [lang != UNKNOWN and score >= bound_of(found, lang, size, least) for lang, score, size in judged]

    return keep_batches(docs, "text", keep)
