"""Ranked lexical search: short posting lists term by term, long ones document by document.

Tasks hold blocks of documents. Within a block the short lists of a query are summed into accumulators, which then are one
list with one bound, beside the long lists with theirs. These are walked together in the order of documents, a window at a
time. Lists whose bounds together stay below the score of the last of the k best so far can't bring a new document in: they
are skipped, and only asked for documents that another list has brought and that can still reach that score. A task keeps
its k best of each query from block to block, so later blocks skip more; the k best of all tasks are then ranked.

No document leaves its partition, and a task tells k rows a query. Queries are taken in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftway.llm.common import lower_words, map_batches, shipped, slices, written

K = 10
#: (item, term) pairs of the queries that are held at once by the driver and each worker.
QUERY_TERMS = 1_000_000
#: Documents of a block, and of a window of the walk through it.
BLOCK, WINDOW = 32_768, 4_096
#: A list is short when it has at most one in so many of a block's documents.
SHORT = 32
_NO_ID = np.iinfo(np.int64).max


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each; rows that repeat an id are one item with the terms of all."""

    def rows(batch):
        return {"item_id": batch.column(0), "terms": pa.array([lower_words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))}

    kind = items.schema["item_id"].dataType.simpleString()
    found = map_batches(items.select("item_id", "text"), rows, f"item_id {kind}, terms array<binary>")
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


class Queries:
    """A block of items with their terms as numbers."""

    def __init__(self, rows: pa.Table):
        ids, terms = rows.column("item_id").combine_chunks(), rows.column("term").combine_chunks()
        coded = terms.dictionary_encode()
        self.vocabulary = {term: k for k, term in enumerate(coded.dictionary.to_pylist())}
        items = ids.dictionary_encode(null_encoding="encode")
        self.items = items.dictionary
        at, numbers = items.indices.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(1, len(self.items)))
        self.terms = np.split(numbers[order], cuts) if len(self.items) else []


def postings(docs: DataFrame, queries) -> DataFrame:
    """doc_id, n (terms with repeats), and the query terms of every document with terms, as raw numbers with their counts."""

    def rows(batch):
        get = queries.value.vocabulary.get
        out = {"doc_id": [], "n": [], "terms": [], "tfs": []}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = lower_words(text)
            if words:
                found = np.fromiter((k for k in map(get, words) if k is not None), np.uint32)
                terms, tfs = np.unique(found, return_counts=True)
                for name, value in zip(out, (doc_id, len(words), terms.tobytes(), tfs.astype(np.uint32).tobytes())):
                    out[name].append(value)
        return out

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_batches(own, rows, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each query term; each task adds its own up first."""

    def rows(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts[np.frombuffer(data, np.uint32)] += 1  # terms of a document are distinct
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["term", "df"])

    shipped(found.sparkSession)
    parts = found.select("terms").mapInArrow(rows, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    table = parts.toArrow()  # a row per query term at most
    out = np.zeros(size, np.int64)
    out[table.column("term").to_numpy()] = table.column("df").to_numpy()
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Index:
    """The posting lists of one block of documents: for each term its documents in ascending order, with their scores."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, counts: np.ndarray, weight: np.ndarray, total: int, length: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        at = np.repeat(place, counts)
        m = 100 - 90 + (90 * n * total) // length
        scores = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, counts)))
        by_term = np.lexsort((at, terms))
        self.docs, self.scores = at[by_term], scores[by_term]
        self.starts = np.searchsorted(terms[by_term], np.arange(len(weight) + 1))

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.docs[part], self.scores[part]


class Best:
    """The k best (score, document) of a query so far; of equal scores the smaller id is the better."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """A document below this score can't come in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def accumulated(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of several lists as one list."""
    docs, where = np.unique(np.concatenate([docs for docs, _ in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, where, np.concatenate([scores for _, scores in lists]))
    return docs, sums


def search(index: Index, terms: np.ndarray, best: Best, short: int = SHORT, window: int = WINDOW) -> int:
    """Brings the block's documents into ``best``; the number of documents whose whole score was computed."""
    lists = [found for found in map(index.list_of, terms.tolist()) if len(found[0])]
    brief = [found for found in lists if len(found[0]) * short <= len(index.ids)]
    lists = [found for found in lists if len(found[0]) * short > len(index.ids)]
    if brief:
        lists.append(accumulated(brief))
    bounds = np.array([int(scores.max()) for _, scores in lists], np.int64)
    order = np.argsort(bounds, kind="stable")
    lists, bounds = [lists[k] for k in order], bounds[order]
    reach = np.cumsum(bounds)  # what the first lists can bring together
    whole = 0
    for low in range(0, len(index.ids), window):
        least = best.least
        skipped = int(np.searchsorted(reach, least, side="left"))
        if skipped == len(lists):
            break
        size = min(window, len(index.ids) - low)
        sums, met = np.zeros(size, np.int64), np.zeros(size, bool)
        for docs, scores in lists[skipped:]:
            a, b = np.searchsorted(docs, (low, low + size))
            sums[docs[a:b] - low] += scores[a:b]
            met[docs[a:b] - low] = True
        found = np.flatnonzero(met)
        for k in range(skipped - 1, -1, -1):
            found = found[sums[found] + reach[k] >= least]
            if not len(found):
                break
            docs, scores = lists[k]
            at = np.minimum(np.searchsorted(docs, found + low), len(docs) - 1)
            sums[found] += np.where(docs[at] == found + low, scores[at], 0)
        found = found[sums[found] >= least]
        whole += len(found)
        if len(found):
            best.add(sums[found], index.ids[low + found])
    return whole


def _ranked(docs: DataFrame, queries: Queries, k: int, block: int) -> DataFrame:
    """item_id, score and doc_id of the k best documents of each task for each item of one block of queries."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(queries)
    found = written(postings(docs, sent), "postings")
    totals = found.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(1)).alias("length")).first()
    total, length = totals["documents"], totals["length"]
    weight = spark.sparkContext.broadcast(weights(document_frequencies(found, len(queries.vocabulary)), total))

    def best_of(batches):
        bests = [Best(k) for _ in sent.value.terms]
        held: list[pa.RecordBatch] = []

        def searched():
            if not held:
                return
            table = pa.Table.from_batches(held)
            ids = table.column("doc_id").fill_null(_NO_ID).to_numpy()
            terms = [np.frombuffer(x, np.uint32) for x in table.column("terms").to_pylist()]
            tfs = np.frombuffer(b"".join(table.column("tfs").to_pylist()), np.uint32)
            index = Index(
                ids, table.column("n").to_numpy(), np.concatenate(terms).astype(np.int64), tfs.astype(np.int64),
                np.array([len(x) for x in terms]), weight.value, total, length,
            )
            for own, best in zip(sent.value.terms, bests):
                search(index, own, best)
            held.clear()

        for batch in slices(batches, block):
            if sum(b.num_rows for b in held) + batch.num_rows > block:
                searched()
            if batch.num_rows:
                held.append(batch)
        searched()
        at = np.repeat(np.arange(len(bests)), [len(b.ids) for b in bests])
        ids = np.concatenate([b.ids for b in bests]) if bests else np.empty(0, np.int64)
        scores = np.concatenate([b.scores for b in bests]) if bests else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [sent.value.items.take(pa.array(at)), pa.array(scores), pa.array(ids, mask=ids == _NO_ID)], names=["item_id", "score", "doc_id"]
        )

    return found.mapInArrow(best_of, f"item_id {_kind(queries)}, score long, doc_id long")


def _kind(queries: Queries) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(queries.items.type).simpleString()


def rank(docs: DataFrame, items: DataFrame, k: int = K, query_block: int = QUERY_TERMS, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of each item with a score above 0.

    Scores are whole numbers; of equal ones the smaller doc_id is ranked first, a null id last. Every row of ``docs`` is a
    document; null texts and those without a term have no score and are not counted. Rows of ``items`` with one id, or
    with none, are one item; one without a term of the documents has no rows. Extra columns are ignored; empty tables
    give an empty result.
    """
    asked = written(query_terms(items), "query-terms")
    blocks = max(1, -(-asked.count() // query_block))
    own = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for number in range(blocks):
        part = _ranked(docs, Queries(asked.filter(own == number).toArrow()), k, block)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
