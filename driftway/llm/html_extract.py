"""Main text of web pages by a tree-structured graphical model.

Every node of a page's tree is a binary variable: a text block is main text or not, an element holds some or not. Node
potentials come from features of elements and blocks, and pair potentials connect each node with its parent by the kind of
the two. Sum-product messages go upward and downward once; the marginals decide which blocks are kept. Weights are fitted
by maximum likelihood on labelled pages, with the same messages giving the expected counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import map_batches
from driftway.llm.html_samples import labelled_pages
from driftway.llm.html_tree import EDGES, FEATURES, Page, features, parse, text_labels

#: Pages of the table, chosen by a hash of the id, whose landmark elements label them, and generated pages, in a fit.
SAMPLE_PAGES, GENERATED_PAGES = 300, 300
STEPS, RATE, DECAY = 200, 0.1, 1e-3
SEED = 29


@dataclass
class Forest:
    """Nodes of many pages in one row, with their parents, depths, edge kinds and features."""

    parents: np.ndarray
    levels: list[np.ndarray]  # nodes of depth 1, 2, ...
    kinds: np.ndarray
    rows: np.ndarray  # node of each active feature
    active: np.ndarray
    starts: list[int]

    @classmethod
    def plant(cls, pages: list[Page]) -> Forest:
        parents, kinds, rows, active, depths, starts = [], [], [], [], [], []
        for page in pages:
            base = len(parents)
            starts.append(base)
            found, own_kinds = features(page)
            for k, up in enumerate(page.parents):
                parents.append(base + up if up >= 0 else -1)
                depths.append(depths[base + up] + 1 if up >= 0 else 0)
                rows += [base + k] * len(found[k])
                active += found[k]
            kinds += own_kinds
        depths = np.array(depths, np.int64)
        order = np.argsort(depths, kind="stable")
        edges = np.searchsorted(depths[order], np.arange(1, (depths.max() if len(depths) else 0) + 2))
        levels = [order[a:b] for a, b in zip(edges, edges[1:])]
        return cls(np.array(parents, np.int64), levels, np.array(kinds, np.int64), np.array(rows, np.int64), np.array(active, np.int64), starts)


@dataclass
class Model:
    nodes: np.ndarray  # FEATURES: log potential of label 1
    pairs: np.ndarray  # EDGES x 2 x 2: log potential of (label of parent, label of child)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def infer(model: Model, forest: Forest, with_pairs: bool = False):
    """Marginals of label 1 of each node; with_pairs: also the joint marginals of each node's edge to its parent."""
    n = len(forest.parents)
    up = np.zeros((n, 2))
    up[:, 1] = np.bincount(forest.rows, weights=model.nodes[forest.active], minlength=n)
    sent = np.zeros((n, 2))
    for level in reversed(forest.levels):
        sent[level] = _log_sum(model.pairs[forest.kinds[level]] + up[level][:, None, :], 2)
        np.add.at(up, forest.parents[level], sent[level])
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2)) if with_pairs else None
    for level in forest.levels:
        above = forest.parents[level]
        rest = up[above] + down[above] - sent[level]  # all that the parent knows but from this child
        both = rest[:, :, None] + model.pairs[forest.kinds[level]]
        down[level] = _log_sum(both, 1)
        down[level] -= down[level].max(axis=1, keepdims=True)
        if with_pairs:
            whole = both + up[level][:, None, :]
            whole = np.exp(whole - whole.max(axis=(1, 2), keepdims=True))
            joint[level] = whole / whole.sum(axis=(1, 2), keepdims=True)
    belief = up + down
    marginals = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    return (marginals, joint) if with_pairs else marginals


def fit(pages: list[tuple[Page, list[int]]], steps: int = STEPS) -> Model:
    """Maximum-likelihood weights (with a small penalty) from pages and the labels of their nodes."""
    model = Model(np.zeros(FEATURES), np.zeros((EDGES, 2, 2)))
    if not pages:
        return model
    forest = Forest.plant([page for page, _ in pages])
    labels = np.array([label for _, own in pages for label in own])
    child = np.concatenate(forest.levels) if forest.levels else np.empty(0, np.int64)
    seen_nodes = np.bincount(forest.active, weights=labels[forest.rows], minlength=FEATURES)
    seen_pairs = np.zeros((EDGES, 2, 2))
    np.add.at(seen_pairs, (forest.kinds[child], labels[forest.parents[child]], labels[child]), 1)
    size = len(pages)
    moments = [[np.zeros_like(model.nodes), np.zeros_like(model.nodes)], [np.zeros_like(model.pairs), np.zeros_like(model.pairs)]]
    for step in range(1, steps + 1):
        marginals, joint = infer(model, forest, with_pairs=True)
        want_nodes = np.bincount(forest.active, weights=marginals[forest.rows], minlength=FEATURES)
        want_pairs = np.zeros((EDGES, 2, 2))
        np.add.at(want_pairs, forest.kinds[child], joint[child])
        for values, slope, (first, second) in (
            (model.nodes, (seen_nodes - want_nodes) / size - DECAY * model.nodes, moments[0]),
            (model.pairs, (seen_pairs - want_pairs) / size - DECAY * model.pairs, moments[1]),
        ):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            values += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return model


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, generated: int = GENERATED_PAGES) -> Model:
    """A model from generated labelled pages and from at most about ``sample`` pages that landmark elements label.

    The sample takes the pages with the smallest hashes of their id; rows without id or html are left out.
    """
    known = pages.filter(F.col("html").isNotNull() & F.col("page_id").isNotNull())
    total = known.count()
    order = F.pmod(F.xxhash64(F.col("page_id").cast("long"), F.lit(SEED)), F.lit(1_000_000))
    chosen = known.filter(order < int(1_000_000 * min(1.0, sample / max(1, total))))
    # one html per id, so that rows which repeat an id do not make the sample grow
    rows = chosen.groupBy(F.col("page_id").cast("long").alias("id")).agg(F.min("html").alias("html")).collect()
    sources = [row["html"] for row in sorted(rows, key=lambda r: r["id"])] + labelled_pages(generated, SEED)
    labelled = []
    for source in sources:
        page = parse(source)
        labels = text_labels(page)
        if labels is not None:
            labelled.append((page, labels))
    return fit(labelled)


def texts_of(model: Model, sources: list[str | None]) -> list[str]:
    """Main text of each page: its kept blocks in page order, with an empty line between them."""
    pages = [parse(source) for source in sources]
    forest = Forest.plant(pages)
    keep = infer(model, forest) >= 0.5
    out = []
    for page, start in zip(pages, forest.starts):
        out.append("\n\n".join(text for k, text in enumerate(page.texts) if text and keep[start + k]))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row; the text is empty where a page has none, or its html is null.

    Repeated rows stay; a null page_id or url stays null; extra columns are ignored.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or train(pages))

    def rows(batch):
        found = texts_of(held.value, batch.column(2).to_pylist())
        return {"page_id": batch.column(0), "url": batch.column(1), "text": found, "n_chars": [len(text) for text in found]}

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    return map_batches(own, rows, "page_id long, url string, text string, n_chars long")
