"""Ranked search, spelling variants and token counts against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftway.llm import hybrid_search, spelling, token_counts
from driftway.llm.tokens import vocabulary
from tests.llm.fixtures import docs, lowered, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string, score string, rank string")


def ranked(rows, items, k=10):
    bags = [(i, Counter(TERM.findall(lowered(t)))) for i, t in rows]
    bags = [(i, bag) for i, bag in bags if bag]
    total, length = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(lowered(text)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms if t in bag)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


def zipf(rng, words):
    return " ".join(f"t{min(int(rng.paretovariate(0.7)), 3000)}" for _ in range(words))


def test_ranks(spark):
    rng = random.Random(3)
    rows = [*texts(), *((100 + i, zipf(rng, rng.randrange(1, 60))) for i in range(900)), *((100 + i, "t1 t2 t3") for i in range(30))]
    asked = [(f"q{k}", zipf(rng, 12)) for k in range(12)]
    asked += [("q0", "T1 more t900"), (None, "t5"), (None, "naïve ÉTÉ"), ("none", None), ("empty", ""), ("unknown", "zzz"), ("all", "t1 t2 t3 t4 w5 no ID")]
    want = sorted(ranked(rows, asked), key=repr)
    items = items_of(spark, [(i, t, "x", "y") for i, t in asked])
    for query_block, block in ((1_000_000, 32_768), (20, 64)):
        found = hybrid_search.rank(docs(spark, rows), items, query_block=query_block, block=block)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == want
    assert hybrid_search.rank(docs(spark).limit(0), items).count() == 0
    assert hybrid_search.rank(docs(spark), items.limit(0)).count() == 0


def test_long_lists_are_skipped():
    """A rare term fills the k best; documents of the common term alone are never scored, and the answer is that of all."""
    rng = np.random.default_rng(4)
    size = 20_000
    rare = np.sort(rng.choice(size, 40, replace=False))
    terms = [np.array([0, 1] if d in set(rare.tolist()) else [0]) for d in range(size)]
    tfs = np.ones(sum(map(len, terms)), np.int64)
    weight = np.array([3, 9000])
    index = hybrid_search.Index(
        np.arange(size), rng.integers(5, 50, size), np.concatenate(terms), tfs, np.array([len(t) for t in terms]), weight, size, 27 * size
    )
    best = hybrid_search.Best(10)
    whole = hybrid_search.search(index, np.array([0, 1]), best)
    sums = np.zeros(size, np.int64)
    for term in (0, 1):
        found, scores = index.list_of(term)
        sums[found] += scores
    want = np.lexsort((np.arange(size), -sums))[:10]
    assert best.ids.tolist() == want.tolist() and best.scores.tolist() == sums[want].tolist()
    assert whole < size / 3


def dictionary(rows, length=7, least=2, every=31):
    held = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= length:
                held[word] += 1
    return {word: n for word, n in held.items() if n >= least}


def is_near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def variants(words, more=10):
    out, form = {}, {}
    for word, n in words.items():
        near = [w for w in words if w != word and is_near(w, word)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        form[word] = best if best is not None and words[best] >= more * n else None
        out[word] = [n, len(near)]
    for word in words:
        root = word
        while form[root]:
            root = form[root]
        out[word] = (word, form[word], root, *out[word], words[form[word]] if form[word] else None)
    return sorted(out.values())


def test_variants(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 12))) for _ in range(40)] + ["aaaaaaaa", "Bookkeeper", "ÀÉ×÷ÿøØabc"]
    rows = [*texts(), (None, "aaaaaaaaa aaaaaaaaa"), (60, "é" * 5000 + " " + "é" * 5000), (61, "é" * 4999 + "," + "é" * 4999)]
    rows += [(70, "chainsaw " * 300), (71, "chainsaws " * 25), (72, "chainsawes " * 2)]  # two steps to the root
    for i in range(150):
        words = []
        for _ in range(40):
            word = base[min(int(rng.paretovariate(0.8)) - 1, len(base) - 1)]
            if rng.random() < 0.1:
                k = rng.randrange(len(word))
                word = word[:k] + rng.choice(["", "a", "é", word[k] * 2]) + word[k + 1 :]
            words.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((200 + i, rng.choice([" ", "-", "1"]).join(words)))
    words = dictionary(rows)
    want = variants(words)
    found = spelling.variants(docs(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect())) == want
    assert sum(row[1] is not None for row in want) > 30 and any(row[1] != row[2] and row[1] for row in want)
    again = spelling.variants(docs(spark, rows), more=2)
    assert sorted(map(tuple, again.collect())) == variants(words, more=2)
    assert spelling.variants(docs(spark).limit(0)).count() == 0


def test_node_numbers_stand_for_prefixes(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(600)}
    found = spelling.numbered(spark.createDataFrame([(w,) for w in words], "word string").repartition(5)).collect()
    number = {}
    for word, nodes in found:
        assert len(nodes) == len(word) + 1
        for k, node in enumerate(nodes):
            assert number.setdefault(word[:k], node) == node
    assert len(set(number.values())) == len(number) and len(found) == len(words)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary())


def long_rows(rng):
    pieces = ["word", " don't", "\n", "\n\n  ", "  ", " ", "é", "日本語", " 12", "<|endoftext|>", "<|endo", "...", "\t", " x1y2", "\U0001f600", " tall"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(300, 900)))) for i in range(30)]
    rows += [(90, "a" * 3000), (91, " " * 2500 + "end"), (92, "go " * 700 + "b" * 900 + " on" * 300), (93, "<|endoftext|>" * 150), (None, "a" * 3000)]
    return rows


def test_token_counts(spark, plain):
    rows = [*texts(), *long_rows(random.Random(6))]
    want = sorted(((i, len((t or "").encode()), n := len(plain.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows), key=repr)
    # small chunks, so that texts have many joints, some of which fail at first
    for long, chunk, overlap in ((200, 100, 20), (500, 300, 40), (65_536, 32_768, 512)):
        found = token_counts.count(docs(spark, rows), long=long, chunk=chunk, overlap=overlap)
        assert sorted(map(tuple, found.collect()), key=repr) == want
    assert token_counts.count(docs(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.count(docs(spark), chunk=10, overlap=5)


def test_overlaps_widen_only_where_they_must(spark, plain):
    texts_ = [("plain", "one two three " * 400), ("solid", "a" * 3000)]
    own = spark.createDataFrame(texts_, "key string, text string")
    first = {r["key"]: r["n_tokens"] for r in token_counts._spliced(own, vocabulary(), 300, 40).collect()}
    assert first == {"plain": len(plain.encode(texts_[0][1]).ids), "solid": None}
    whole = {r["key"]: r["n_tokens"] for r in token_counts.long_counts(own, vocabulary(), 300, 40).collect()}
    assert whole == {key: len(plain.encode(text).ids) for key, text in texts_}


def test_a_megabyte_text(spark, plain):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("aeinorstlé") for _ in range(rng.randrange(1, 9))) for _ in range(200_000))
    assert len(text.encode()) > 1_000_000
    found = token_counts.count(docs(spark, [(1, text), (2, text), (3, "short")])).collect()
    n = len(plain.encode(text).ids)
    assert sorted(map(tuple, found)) == [(1, len(text.encode()), n, True), (2, len(text.encode()), n, True), (3, 5, 1, False)]


def test_other_vocabularies(spark):
    import public_tokenizers
    import sentencepiece

    rows = [*texts(), (70, "long text here " * 9000)]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        if name.endswith("model"):
            plain = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            library = Tokenizer.from_file(path)
            plain = lambda t: library.encode(t, add_special_tokens=False).ids
        found = token_counts.count(docs(spark, rows), path).select("doc_id", "n_tokens").collect()
        assert sorted(map(tuple, found), key=repr) == sorted(((i, len(plain(t or ""))) for i, t in rows), key=repr)
