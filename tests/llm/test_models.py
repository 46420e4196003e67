"""Quality classifier, language profiles and the tree model: exact parts, odd rows and held-out accuracy."""

import numpy as np
import pytest

from driftway.llm import html_extract, html_tree, langid, quality
from driftway.llm.html_samples import labelled_pages
from tests.llm.fixtures import docs, held, texts

TABLES = "/root/testdata/sf0.01"


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(8, 4, replace=False)) for _ in range(60)]
    values = [rng.normal(size=4) for _ in rows]
    signs = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    costs = np.full(60, 0.5)
    weights, bias = quality.dual_coordinate_descent(rows, values, signs, costs, epochs=3000)

    def loss(w, b):
        margins = np.array([w[i] @ x + b for i, x in zip(rows, values)])
        return (w @ w + b * b) / 2 + (costs * np.maximum(0, 1 - signs * margins)).sum()

    best = loss(weights, bias)
    for _ in range(300):
        step = np.zeros_like(weights)
        step[:8] = rng.normal(size=8) * 0.02
        assert loss(weights + step, bias + rng.normal() * 0.02) >= best - 2e-3


def test_log_count_ratios():
    rows = [np.array([0, 1]), np.array([1]), np.array([2])]
    ratios = quality.log_count_ratios(rows, np.array([1, 1, 0]))
    size = quality.SPACE
    assert ratios[1] == pytest.approx(np.log((3 / (3 + size)) / (1 / (1 + size))))
    assert ratios[2] < 0 < ratios[0] < ratios[1]


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(k, k % 2, 0, "x") for k in range(1, 15)] + [(None, 1, 0, "x"), (1, None, 0, "x"), (99, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    own = docs(spark)
    found = quality.score(own, labels).collect()
    assert len(found) == len(texts())
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    none = quality.score(own, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(own.limit(0), labels).count() == 0
    assert quality.accepted(own, labels).columns == own.columns


def test_quality_held_out_accuracy(spark):
    table, labels = (spark.read.parquet(f"{TABLES}/{name}.parquet") for name in ("documents", "labels"))
    found = quality.score(table, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(found) > 50 and np.mean([r["predicted"] == r["quality"] for r in found]) >= 0.95


def test_bound_and_bundled_vectors():
    letters = langid.letter_vectors(64)
    grams, counts = langid.gram_counts("Abc abc")
    want = np.zeros(64)
    symbols = [0, 1, 2, 3, 0, 1, 2, 3, 0]
    for k in range(len(symbols) - 2):
        want += np.roll(letters[symbols[k]], 2) * np.roll(letters[symbols[k + 1]], 1) * letters[symbols[k + 2]]
    assert np.array_equal(langid.Bundler(64).bundle(grams, counts), want)
    assert counts.sum() == 7 and len(langid.gram_counts("12 ! \U0001f600")[0]) == 0


def test_language_of_odd_rows(spark):
    found = langid.predict(docs(spark, lang={1: None, 12: "ja"})).collect()
    assert len(found) == len(texts())
    unknown = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert {5, 6, 7, 13} <= unknown and all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in found)
    empty = docs(spark).limit(0)
    assert langid.predict(empty).count() == 0
    nothing = langid.predict(docs(spark), langid.train(empty)).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet(f"{TABLES}/documents.parquet")
    found = langid.predict(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.97


FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
]


def test_language_filter_drops_what_was_not_learned(spark):
    table = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(FOREIGN)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.accepted(table.unionByName(more)).select("doc_id").collect()}
    assert not kept & {-1 - k for k in range(len(FOREIGN))}
    clean = [r["doc_id"] for r in table.filter("length(text) >= 40").collect() if held(r["doc_id"])]
    share = np.mean([i in kept for i in clean])
    assert share >= 0.95


def brute_marginals(model, page):
    found, kinds = html_tree.features(page)
    n = len(page.parents)
    total, ones = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [(code >> k) & 1 for k in range(n)]
        score = sum(model.nodes[found[k]].sum() for k in range(n) if y[k])
        score += sum(model.pairs[kinds[k]][y[page.parents[k]], y[k]] for k in range(1, n))
        weight = np.exp(score)
        total += weight
        ones += weight * np.array(y)
    return ones / total


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(4)
    model = html_extract.Model(rng.normal(size=html_tree.FEATURES), rng.normal(size=(html_tree.EDGES, 2, 2)))
    pages = [html_tree.parse(s) for s in ("<div><p>One two.<p>Three <a href=x>four</a></div><ul><li>a<li>b</ul>", "", "<article><h1>T</h1>text</article>")]
    forest = html_extract.Forest.plant(pages)
    got = html_extract.infer(model, forest)
    want = np.concatenate([brute_marginals(model, page) for page in pages])
    assert np.allclose(got, want)


def test_parser_reads_broken_markup():
    source = "<p>a &amp; b&nbsp; c<p>d<b>e</b>f<br>g<script>var t='</p>'; x<y</script><li>x<li>y<!-- no > --><div>&am<p title='>'>z</p>end<i"
    page = html_tree.parse(source)
    assert [t for t in page.texts if t] == ["a & b c", "def g", "x", "y", "&am", "z", "end"]
    for odd in (None, "", "<", "<<<>>>", "<p", "</p></div>", "<a href='x", "text only", "<script>never closed", "\x00<p>�"):
        html_tree.parse(odd)


def test_main_text_of_labelled_pages_and_odd_rows(spark):
    sources = labelled_pages(60, 91)
    rows = [(k, f"u{k}", s, "x") for k, s in enumerate(sources)] + [(100, None, None, "x"), (None, "u", "", "x"), (101, "u", "<p>&lt;b&gt;", "x"), (101, "u", "<p>&lt;b&gt;", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    found = html_extract.extract(table).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    got = {r["page_id"]: r["text"] for r in found}
    assert got[100] == "" and got[None] == ""
    right = 0
    for k, source in enumerate(sources):
        page = html_tree.parse(source)
        labels = html_tree.text_labels(page)
        right += got[k] == "\n\n".join(t for t, y in zip(page.texts, labels) if t and y)
    assert right >= 0.9 * len(sources)
    assert html_extract.extract(table.limit(0)).count() == 0
