"""License scans, decontamination, SimHash groups and I-Match against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash

from driftway.llm import decontam, imatch, licenses, near_copies, simhash
from tests.llm.fixtures import docs, lowered, prose, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_places_and_labels(spark):
    rows = [
        (1, "Released under the MIT License. mit LICENSE, and the Apache-License!"), (2, "released under mit license"),
        (3, "This nice work is licensed under the GNU General Public License, version 3."), (4, None), (5, ""),
        (6, "Licensed under CC BY-NC 4.0. All rights reserved."), (7, "general public licenses"), (None, "mit license"), (1, "mit license"),
    ]
    found = licenses.scan(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    got = {(r["doc_id"], r["n_words"]): r for r in found}
    first = got[1, 11]
    assert (first["n_base"], first["first_word"], first["last_word"]) == (3, 3, 9)
    assert first["base_labels"] == "apache,mit" and first["labels"] == "apache,mit,mit-notice" and first["score"] == pytest.approx(1 / 3)
    assert got[2, 4]["labels"] == "mit"  # "the" is mandatory in the notice
    assert got[3, 13]["labels"] == "gpl,gpl-notice" and got[3, 13]["spans"] == "gpl-notice:0-12,gpl-notice:4-12"
    assert got[6, 10]["labels"] == "cc-notice,reserved"
    for key in ((4, 0), (5, 0)):
        assert got[key]["first_word"] is None and got[key]["labels"] == "" and got[key]["score"] == 0
    assert got[7, 3]["n_base"] == 0


def test_template_regions():
    made = licenses.Automaton.compile("t", "a [[b {{1-2}}]] c {{0-2}} d")
    accepted = ["a c d", "a b x c d", "a b x y c z z d"]
    for text in accepted:
        assert made.longest(text.encode().split(), 0) == len(text.split())
    for text in ("a b c d", "a c z z z d", "a d", "a b x y z c d"):
        assert made.longest(text.encode().split(), 0) == -1
    with pytest.raises(ValueError):
        licenses.Automaton.compile("t", "[[a]]")


def hit_words(words, items, window=13):
    grams = {}
    for item, own in items:
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            grams.setdefault(tuple(own[k : k + n]), set()).add(item)
    hit, found = set(), set()
    for n in {len(g) for g in grams}:
        for k in range(len(words) - n + 1):
            who = grams.get(tuple(words[k : k + n]))
            if who:
                hit |= set(range(k, k + n))
                found |= who
    return len(hit), {i for i in found if i is not None}


@pytest.mark.parametrize("block_words", [2_000_000, 30])
def test_decontamination(spark, block_words):
    own = texts()
    long_item = " ".join(own[0][1].split()[20:60])
    items = [
        (1, long_item), (2, "one"), (3, "Two, words!"), (4, ""), (5, None), (None, "no id at"), (6, long_item),
        (7, " ".join(own[3][1].split()[-13:])), (8, " ".join(own[3][1].split()[5:17])), (9, "w1 " * 40), (10, long_item),
    ]
    rows = own + [(20, "w1 " * 100), (21, "x " * 300 + long_item), (22, "w1 " * 12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.scan(docs(spark, rows), benchmark, block_words=block_words).collect()
    assert len(found) == len(rows)
    split = [(i, WORD.findall(lowered(t))) for i, t in items]
    want = []
    for i, text in rows:
        words = WORD.findall(lowered(text))
        n, ids = hit_words(words, split)
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        want.append((i, len(words), n, len(ids), digest, n > 0 and 20 * n >= len(words)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = decontam.decontaminated(docs(spark, rows), benchmark)
    assert kept.columns == docs(spark, rows).columns
    assert kept.count() == sum(not w[5] for w in want)


def test_benchmark_stays_on_executors(spark, monkeypatch):
    words = prose(random.Random(9), 900).split()
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, "no id at all")], "item_id long, text string")

    def refuse(*_, **__):
        raise AssertionError("texts of the benchmark reach the driver")

    monkeypatch.setattr(type(benchmark), "toLocalIterator", refuse)
    assert {len(piece) for piece in decontam._pieces(words, 13, 50)} <= set(range(13, 51))
    rows = [(k, " ".join(words[k : k + 13])) for k in range(0, 880, 7)] + [(None, "no id at all here"), (5000, " ".join(words[:12]))]
    found = decontam.scan(docs(spark, rows), benchmark, block_words=50).collect()
    assert len(found) == len(rows) and all(r["n_hit"] == {None: 4, 5000: 0}.get(r["doc_id"], 13) for r in found)


def test_winnowing_keeps_a_hash_of_every_shared_span():
    rng = np.random.default_rng(3)
    for _ in range(200):
        shared = [b"%d" % x for x in rng.integers(0, 5, 13)]
        sides = [[b"%d" % x for x in rng.integers(0, 5, 20)] + shared + [b"%d" % x for x in rng.integers(0, 5, 20)] for _ in range(2)]
        kept = []
        for words in sides:
            hashes = decontam.gram_hashes(words, 5)
            own = decontam.winnow(hashes, 9)
            kept.append({int(hashes[k]) for k in own if 20 <= k <= 28})
        assert kept[0] & kept[1]


def test_no_benchmark_and_no_documents(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(docs(spark), nothing).filter("n_hit > 0 or contaminated").count() == 0
    empty = docs(spark).limit(0)
    assert decontam.scan(empty, nothing).count() == licenses.scan(empty).count() == simhash.groups(empty).count() == 0
    assert imatch.compare_with_next(empty).count() == simhash.deduplicated(empty).count() == 0


def simhash_of(text):
    words = re.findall("[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    rows = texts()
    found = simhash.groups(docs(spark, rows)).collect()
    marks = [(i, simhash_of(t)) for i, t in rows]
    names = list(range(len(marks)))
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= 2:
                old, new = names[a], names[b]
                names = [new if n == old else n for n in names]
    want = []
    for k, (i, mark) in enumerate(marks):
        ids = [marks[j][0] for j in range(len(marks)) if names[j] == names[k] and marks[j][0] is not None]
        want.append((i, f"{mark:016x}", min(ids, default=None)))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=repr) == sorted(want, key=repr)
    kept = simhash.deduplicated(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert kept.count() == len(set(names))


def test_groups_that_share_an_id_keep_a_row_each(spark):
    one, two = (prose(random.Random(k), 60, 1000 * k) for k in (1, 2))
    for i in (None, 5):
        kept = simhash.deduplicated(docs(spark, [(i, one), (i, two), (i, one), (i, two)])).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(i, one), (i, two)], key=repr)


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_links_are_complete_in_both_ways(spark, limit):
    rng = np.random.default_rng(8)
    marks = set()
    for seed in rng.integers(-(1 << 63), 1 << 63, 6, dtype=np.int64).tolist() + [0, -1]:
        for _ in range(30):
            x = seed
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                x ^= 1 << bit if bit < 63 else -(1 << 63)
            marks.add(x)
    marks = sorted(marks)
    pairs = {(a, b) for a in marks for b in marks if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(m,) for m in marks], "fp long"), limit).collect()}
    assert found <= pairs

    def parts(edges):
        names = {m: m for m in marks}
        for a, b in edges:
            old, new = names[a], names[b]
            names = {m: new if n == old else n for m, n in names.items()}
        return sorted(tuple(sorted(m for m in marks if names[m] == n)) for n in set(names.values()))

    assert parts(found) == parts(pairs)
    if limit == 1000:
        assert found == pairs


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(k + 1, k) for k in range(n)] + [(1000, 999)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {**{k: 0 for k in range(n + 1)}, 999: 999, 1000: 999}


def test_imatch_rows(spark):
    rows = texts()
    found = imatch.compare_with_next(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + after[:quarter]
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=repr) == sorted(want, key=repr)
    marks = {r["doc_id"]: r for r in found}
    assert marks[1]["fingerprint"] == marks[2]["fingerprint"] != marks[4]["fingerprint"]
    assert marks[1]["near_next"] == 1.0 and marks[5]["fingerprint"] == marks[6]["fingerprint"] == "0" * len(marks[5]["fingerprint"])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


def test_imatch_is_the_same_over_any_number_of_ranges(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(imatch.compare_with_next(table).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == table.count()
    near, following = np.mean([r["near_edited"] for r in results[0]]), np.mean([r["near_next"] for r in results[0]])
    assert near > following + 0.3


def test_imatch_band(spark):
    rows = [(k, f"common word{k % 3} own{k}") for k in range(30)]
    lexicon = set(imatch.lexicon_of(docs(spark, rows), low=0.1, high=0.5).tolist())
    want = {xxhash.xxh3_64_intdigest(f"word{k}".encode()) for k in range(3)}
    assert lexicon == want


def five_word_shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("limit", [0, 16])
def test_near_copies_against_all_pairs(spark, limit):
    rng = random.Random(8)
    line = prose(rng, 12, 5000)
    rows = texts()
    for base in range(6):
        words = (prose(rng, rng.choice([40, 150]), 400 * base) + " " + line).split()
        for copy in range(9):
            some = list(words)
            for at in rng.sample(range(len(words)), copy * len(words) // 150):
                some[at] = f"new{rng.randrange(10**6)}"
            rows.append((100 + 10 * base + copy, " ".join(some)))
    rng.shuffle(rows)
    sets = [five_word_shingles(t) for _, t in rows]
    names = list(range(len(rows)))
    linked = 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                linked += sets[a] != sets[b]
                old, new = names[a], names[b]
                names = [new if n == old else n for n in names]
    assert linked > 20
    best = {}
    for (i, text), name in zip(rows, names):
        best.setdefault(name, []).append((i is None, i or 0))
    kept = near_copies.deduplicated(docs(spark, rows), limit=limit).collect()
    assert len(kept) == len(best)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(map(min, best.values()))


def test_near_copies_are_linked_by_their_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for base in range(20):
        words = prose(rng, 400, 1000 * base).split()
        rows += [(10 * base, " ".join(words)), (10 * base + 1, " ".join([*words, "more"]))]  # one shingle more
    sets = [near_copies.shingles(t).view(np.uint64) for _, t in rows]
    marks = [simhash.majority(s) for s in sets]
    near = [k for k in range(0, 40, 2) if ((marks[k] ^ marks[k + 1]) & (2**64 - 1)).bit_count() <= 2]
    assert len(near) > 10
    monkeypatch.setattr(near_copies, "_paired", lambda members: near_copies_none(members))
    monkeypatch.setattr(near_copies, "_starred", lambda members: near_copies_none(members))
    kept = {r["doc_id"] for r in near_copies.deduplicated(docs(spark, rows)).collect()}
    # without shingle prefixes, just the links of fingerprints are left
    assert {10 * base for base in range(20)} <= kept and len(kept) == len(rows) - len(near)


def near_copies_none(members):
    return members.select(members["set"].alias("a"), members["set"].alias("b")).limit(0)


def test_prefixes_against_a_long_list_take_no_time():
    rng = np.random.default_rng(8)
    common = np.unique(rng.integers(-(1 << 62), 1 << 62, 1_000_000))
    sets = [np.unique(np.concatenate([rng.choice(common, 40), rng.integers(-(1 << 62), 1 << 62, 300)])) for _ in range(2_000)]
    start = time.perf_counter()
    got = [near_copies.prefix(found, common) for found in sets]
    assert time.perf_counter() - start < 5  # the sort of the whole list for each set took over half an hour
    for found, first in list(zip(sets, got))[:5]:
        last = np.isin(found, common)
        want = np.concatenate([found[~last], found[last]])[: len(found) - -(-4 * len(found) // 5) + 1]
        assert first.tolist() == want.tolist()
    assert near_copies.prefix(sets[0], common[:0]).tolist() == sets[0][: len(sets[0]) - -(-4 * len(sets[0]) // 5) + 1].tolist()
    assert near_copies.prefix(sets[0][:0], common).tolist() == []


def near_family(rng, copies, changes, first, words=170):
    """(doc_id, text) of one text and its copies, each with up to ``changes`` words replaced."""
    base, rows = prose(rng, words, first).split(), []
    for copy in range(copies):
        some = list(base)
        for at in rng.sample(range(words), rng.randrange(changes + 1)):
            some[at] = f"new{rng.randrange(40)}"
        rows.append((first + copy, " ".join(some)))
    return rows


def groups_of_all_pairs(texts):
    """The smallest place of each text's group, by all pairs of their sets of shingles."""
    sets = [five_word_shingles(t) for t in texts]
    column = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(column)), np.float32)
    for row, own in zip(held, sets):
        row[[column[s] for s in own]] = 1
    n = held.sum(axis=1)
    near = 9 * (held @ held.T) >= 4 * (n[:, None] + n[None, :])
    names = np.arange(len(sets))
    while True:
        after = np.array([names[row].min() for row in near])
        if (after == names).all():
            return names
        names = after


@pytest.mark.parametrize("limit", [1, 16])
def test_near_copies_that_share_most_shingles_are_not_paired_all(spark, monkeypatch, limit):
    """Pairs under a crowded shingle grow with its members, not with their square, and no group is lost."""
    rng = random.Random(11)
    line, formed = prose(rng, 60, 90_000), []
    possible = near_copies._possible

    def counted(pairs, nodes):
        formed.append(pairs.count())
        return possible(pairs, nodes)

    monkeypatch.setattr(near_copies, "_possible", counted)
    rows = near_family(rng, 500, 8, 1000)
    for first in (2000, 3000):  # two families with a long passage in common
        rows += [(i, f"{text} {line}") for i, text in near_family(rng, 150, 10, first, 150)]
    names = groups_of_all_pairs([t for _, t in rows])
    assert 20 < len(set(names)) < 600
    kept = {r["doc_id"] for r in near_copies.deduplicated(docs(spark, rows), limit=limit).collect()}
    assert kept == {rows[k][0] for k in set(names.tolist())}
    assert sum(formed) < 25 * len(rows)


def test_large_crowds_of_near_copies_make_no_row_of_each_shingle(spark, monkeypatch):
    """What a large crowd writes follows its members, not their shingles, and no group is lost."""
    rng = random.Random(12)
    rows = near_family(rng, 500, 24, 1000)
    names = groups_of_all_pairs([t for _, t in rows])
    assert 100 < len(set(names)) < 450
    kept, sizes = near_copies.written, []

    def counted(df, label):
        out = kept(df, label)
        sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    found = {r["doc_id"] for r in near_copies.deduplicated(docs(spark, rows)).collect()}
    assert found == {rows[k][0] for k in set(names.tolist())}
    after = sizes[[label for label, _ in sizes].index("split") + 1 :]
    assert "crowds" in {label for label, _ in after}
    assert max(n for _, n in after) <= 2 * len(rows)


@pytest.mark.parametrize(("block", "held", "largest"), [(64, 10**6, 10**6), (512, 2000, 10**6), (16, 10**6, 100), (512, 10**6, 0)])
def test_blocks_and_differences_of_large_crowds_find_the_same_groups(spark, monkeypatch, block, held, largest):
    for name, value in (("BLOCK", block), ("BLOCK_SHINGLES", held), ("LARGEST", largest), ("COLUMNS", 100)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(13)
    rows = near_family(rng, 300, 24, 1000) + near_family(rng, 120, 10, 2000, 120)
    names = groups_of_all_pairs([t for _, t in rows])
    kept = {r["doc_id"] for r in near_copies.deduplicated(docs(spark, rows), limit=4).collect()}
    assert kept == {rows[k][0] for k in set(names.tolist())}


def test_overlaps_and_joining_against_plain_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, k)) for k in rng.integers(1, 50, 40)]
    shared = near_copies.overlaps(sets[:25], sets[25:])
    assert shared.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[25:]] for x in sets[:25]]
    assert not near_copies.overlaps([np.array([1, 2])], [np.array([3])]).any()
    near = np.array([[True, True, False], [True, False, False], [False, False, True]])
    assert near_copies.joining(near, [1, 1, 2], [3, 4, 5]) == [(0, 0), (0, 1), (2, 2)]
