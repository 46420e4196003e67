import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from driftway.functions import special
from driftway.operators import draws, inspection, resample, spectra
from driftway.operators.spectra import PAIR

SCHEMA = "chrom string, pos long, ref string, alt string, population string, alt_count long, called_chromosomes long"


def counts_of(spark, rows):
    """rows: (pos, population, alt, called)"""
    return spark.createDataFrame([("1", p, "A", "G", pop, x, n) for p, pop, x, n in rows], SCHEMA)


def ab(spark):
    return spark.createDataFrame([("A", "B")], "population_a string, population_b string")


def configs_of(spark, rows):
    return spectra.configurations(spectra.shared_loci(counts_of(spark, rows), ab(spark)))


def cells(df):
    return {(r["i"], r["j"]): r["mass"] for r in df.collect()}


EXACT = [(10, "A", 1, 4), (10, "B", 3, 4), (20, "A", 2, 4), (20, "B", 0, 4), (30, "A", 1, 2), (30, "B", 2, 4)]


def test_exact_spectrum(spark):
    configs = configs_of(spark, EXACT)
    assert cells(spectra.exact_spectra(configs)) == {(1, 3): 1, (2, 0): 1}
    assert cells(spectra.exact_spectra(configs, 2, 4)) == {(1, 2): 1}
    stats = spectra.spectrum_stats(
        configs, spectra.candidate_loci(counts_of(spark, EXACT), ab(spark), configs),
        (F.col("n_a") == 4) & (F.col("n_b") == 4),
    ).first()
    assert (stats["loci_used"], stats["loci_skipped"]) == (2, 1)


def test_mode_tie_takes_the_smaller_size(spark):
    rows = [(1, "A", 0, 6), (1, "B", 0, 4), (2, "A", 0, 4), (2, "B", 0, 4)]
    row = spectra.modal_sizes(configs_of(spark, rows)).first()
    assert (row["chromosomes_a"], row["chromosomes_b"]) == (4, 4)


def test_loci_seen_on_one_side_count_as_skipped(spark):
    rows = [*EXACT, (40, "A", 1, 4), (50, "B", 1, 4), (50, "C", 1, 4)]
    counts = counts_of(spark, rows)
    configs = configs_of(spark, rows)
    assert spectra.candidate_loci(counts, ab(spark), configs).first()["loci_either"] == 5


def pmf(k, n, x, t):
    if k > x or t - k > n - x:
        return 0.0
    return math.comb(x, k) * math.comb(n - x, t - k) / math.comb(n, t)


def test_projection_against_brute_force(spark):
    rows = []
    for pos in range(1, 60):
        rows.append((pos, "A", pos % 5, 4 + pos % 7))
        if pos % 4:
            rows.append((pos, "B", pos * 3 % 6, 5 + pos % 40))
    got = cells(spectra.projected_spectra(configs_of(spark, rows), 4, 6))
    want = dict.fromkeys(product(range(5), range(7)), 0.0)
    b = {p: (x, n) for p, pop, x, n in rows if pop == "B"}
    for p, pop, x, n in rows:
        if pop == "A" and p in b and n >= 4 and b[p][1] >= 6:
            for i, j in want:
                want[i, j] += pmf(i, n, x, 4) * pmf(j, b[p][1], b[p][0], 6)
    for cell, mass in want.items():
        assert got.get(cell, 0.0) == pytest.approx(mass, abs=1e-10)


def test_projection_of_large_samples(spark):
    sizes = spark.createDataFrame([(5000, 1700), (40, 40), (40, 0)], "called long, alt long")
    table = special.hypergeom_table(sizes, 20)
    for row in table.collect():
        assert row["p"] == pytest.approx(pmf(row["k"], row["called"], row["alt"], 20), rel=1e-9)
    assert all(abs(r["s"] - 1) < 1e-9 for r in table.groupBy("called", "alt").agg(F.sum("p").alias("s")).collect())


def test_log_gamma(spark):
    row = spark.createDataFrame([(0.0,), (0.3,), (7.5,), (1e6,)], "x double")
    for r in row.select("x", special.log_gamma1p(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.lgamma(r["x"] + 1), rel=1e-12, abs=1e-12)


def test_short_locus_is_not_projected(spark):
    rows = [(1, "A", 1, 2), (1, "B", 1, 4)]
    assert cells(spectra.projected_spectra(configs_of(spark, rows), 4, 4)) == {}


def test_both_ways_of_pairing_agree(spark):
    rows = [(p, pop, (p + k) % 4, 4 + (p * k) % 3) for p in range(30) for k, pop in enumerate("ABCD") if (p + k) % 5]
    counts = counts_of(spark, rows)
    pairs = inspection.population_pairs(counts)
    assert pairs.count() == 6
    near = spectra.shared_loci(counts, pairs)
    joined = spectra.shared_loci(counts, pairs, max_pairs=1)
    assert near.count() > 0 and near.exceptAll(joined).count() == 0 and joined.exceptAll(near).count() == 0


def test_hot_repeated_locus_folds_to_one_row(spark):
    hot = spark.range(20000).select(
        F.lit("1").alias("chrom"), F.lit(7).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"),
        F.lit("A").alias("population"), (F.col("id") % 5).alias("alt_count"), F.lit(8).cast("long").alias("called_chromosomes"),
        (F.col("id") * 7919 % 20000).alias("line_no"),
    )
    assert [r["alt_count"] for r in spectra.first_counts(hot).collect()] == [0]


def test_pairs_are_checked(spark):
    counts = counts_of(spark, EXACT)
    schema = "population_a string, population_b string"
    with pytest.raises(ValueError, match="two populations, not one twice"):
        spectra.check_pairs(counts, spark.createDataFrame([("A", "A")], schema))
    with pytest.raises(ValueError, match="absent from the counts table: Z"):
        spectra.check_pairs(counts, spark.createDataFrame([("A", "Z")], schema))


def test_fold_keeps_inner_mass(spark):
    rows = [("A", "B", i, j, float(1 + i * 5 + j)) for i in range(5) for j in range(5)]
    table = spark.createDataFrame(rows, "population_a string, population_b string, i long, j long, mass double")
    folded = cells(spectra.fold_spectra(table, 4, 4))
    inner = {(i, j): m for _, _, i, j, m in rows if (i, j) not in ((0, 0), (4, 4))}
    assert sum(folded.values()) == pytest.approx(sum(inner.values()))
    assert all(i + j <= 4 for i, j in folded)
    assert folded[1, 0] == inner[1, 0] + inner[3, 4]
    assert folded[1, 3] == pytest.approx((inner[1, 3] + inner[3, 1]) / 2)
    assert cells(spectra.fold_spectra(table, 4, 4, polarized=True)) == inner
    assert len(cells(spectra.dense_cells(table.filter("i = 1"), 4, 4))) == 25
    with pytest.raises(Exception, match="not a finite number from 0 up"):
        spectra.validate_spectra(table.withColumn("mass", -F.col("mass"))).collect()


def test_retention(spark):
    rows = [(1, "A", 1, 4), (1, "B", 1, 4), (2, "A", 1, 2), (2, "B", 1, 4), (3, "A", 1, 4), (3, "B", 1, 2)]
    counts = counts_of(spark, rows)
    pairs = inspection.population_pairs(counts)
    configs = spectra.configurations(spectra.shared_loci(counts, pairs))
    table = {r["projection_chromosomes"]: r for r in inspection.projection_retention(counts, configs, pairs).collect()}
    assert sorted(table) == [2, 4]
    assert table[4]["minimum_pair_loci"] == 1 and table[4]["minimum_pair_retention"] == pytest.approx(1 / 3)
    summary = spark.createDataFrame([(2, 1.0), (4, 0.9), (6, 0.8), (8, 0.4)], "projection_chromosomes long, minimum_pair_retention double")
    assert inspection.recommend_projection(summary, 0.80).first()[0] == 6
    assert inspection.recommend_projection(summary.filter("projection_chromosomes = 8")).first()[0] == 8


BOOT = [(k * 100, pop, (k + s) % 5, 4) for k in range(1, 7) for s, pop in enumerate("AB")]


def test_locus_bootstrap(spark):
    configs = configs_of(spark, BOOT)
    drawn = resample.resample_loci(configs, 20, 9, 4, 4)
    again = resample.resample_loci(configs.repartition(5), 20, 9, 4, 4)
    total = {r["replicate"]: r["m"] for r in drawn.groupBy("replicate").agg(F.sum("mass").alias("m")).collect()}
    assert len(total) == 20 and all(m == pytest.approx(6.0) for m in total.values())
    key = lambda df: sorted((r["replicate"], r["i"], r["j"], round(r["mass"], 9)) for r in df.collect())
    assert key(drawn) == key(again)
    estimates = resample.linear_moment_estimator(drawn, [*PAIR, "replicate"])
    row = resample.bootstrap_summary(estimates, attempted=20).first()
    assert row["successful_replicates"] == row["attempted_replicates"] == 20
    assert row["probability_a_to_b_stronger"] == row["preferred_direction_support"] == 1.0
    assert row["m_a_to_b_lower"] <= row["m_a_to_b_mean"] <= row["m_a_to_b_upper"]


def test_multinomial_weights_over_buckets(spark):
    units = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("unit"), (1 + F.col("id") % 3).alias("n"))
    weights = draws.multinomial_weights(units, ["k"], ["unit"], "n", 40, 3, bucket_bits=4)
    sizes = {r["k"]: r["s"] for r in units.groupBy("k").agg(F.sum("n").alias("s")).collect()}
    per = weights.groupBy("k", "replicate").agg(F.sum("weight").alias("s")).collect()
    assert len(per) == 80 and all(r["s"] == sizes[r["k"]] for r in per)
    mean = weights.join(units, ["k", "unit"]).groupBy("n").agg(F.sum("weight").alias("w")).collect()
    share = {r["n"]: r["w"] / 40 / (100 * r["n"]) for r in mean}
    assert all(0.9 < v < 1.1 for v in share.values())


def test_block_bootstrap(spark):
    shared = spectra.shared_loci(counts_of(spark, BOOT), ab(spark))
    blocks = resample.block_spectra(shared, 200, 4, 4)
    # Positions 100 and 200 share the first window because windows start at 1.
    windows = {r["block"]: r["m"] for r in blocks.groupBy("block").agg(F.sum("mass").alias("m")).collect()}
    assert {k: round(m, 9) for k, m in windows.items()} == {0: 2.0, 1: 2.0, 2: 2.0}
    drawn = resample.resample_blocks(blocks, 5, 1)
    totals = drawn.groupBy("replicate").agg(F.sum("mass").alias("m")).collect()
    assert len(totals) == 5 and all(r["m"] == pytest.approx(6.0) for r in totals)
    with pytest.raises(Exception, match="one block can't be resampled"):
        resample.resample_blocks(resample.block_spectra(shared, 10_000, 4, 4), 5, 1).collect()
    with pytest.raises(ValueError):
        resample.block_spectra(shared, 0, 4, 4)
    assert resample.resampling_unit_label(None) == "locus"
    assert resample.resampling_unit_label(500) == "500-bp genomic block"


def test_python_estimator_tells_failures(spark):
    drawn = resample.resample_loci(configs_of(spark, BOOT), 4, 1, 4, 4)

    keys = [*PAIR, "replicate"]
    masses = {r["replicate"]: r["m"] for r in drawn.groupBy("replicate").agg(F.sum(F.col("i") * F.col("mass")).alias("m")).collect()}
    limit = sorted(masses.values())[1]  # the fit of one replicate, the smallest, fails

    def fit(frame):
        if (frame["i"] * frame["mass"]).sum() < limit - 1e-9:
            raise ValueError("too little mass")
        return 0.1, 0.2

    estimates = resample.grouped_estimator(fit)(drawn, keys)
    row = resample.bootstrap_summary(estimates, attempted=5).first()
    failed = sum(m < limit - 1e-9 for m in masses.values())
    assert failed >= 1
    assert (row["successful_replicates"], row["attempted_replicates"], row["preferred_direction_support"]) == (4 - failed, 5, 1.0)

    told = resample.grouped_estimator(fit)(drawn, keys).filter("failure IS NOT NULL").collect()
    assert len(told) == failed and all(r["failure"] == "ValueError: too little mass" for r in told)

    def never(frame):
        raise KeyError("no such model")

    lost = resample.grouped_estimator(never)(drawn, keys)
    assert lost.count() == 4 and {r["failure"] for r in lost.collect()} == {"KeyError: 'no such model'"}
    with pytest.raises(Exception, match="only one replicate, or none"):
        resample.bootstrap_summary(lost, attempted=5).collect()


def test_draws_of_a_key_do_not_depend_on_other_keys(spark):
    own = [("a", u, 3) for u in range(30)]
    other = [("b", u, 2) for u in range(500)]
    drawn = []
    for rows in (own, own + other):
        units = spark.createDataFrame(rows, "k string, unit int, n int")
        found = draws.multinomial_weights(units, ["k"], ["unit"], "n", 20, 3, bucket_bits=4)
        drawn.append(sorted(map(tuple, found.filter("k = 'a'").collect())))
    assert drawn[0] == drawn[1] and len(drawn[0]) > 100


def test_block_bootstrap_by_configuration_equals_the_one_by_cell(spark):
    shared = spark.createDataFrame(
        [("A", "B", "1", p, 4 + p % 2, p % 5, 4, (3 * p) % 5) for p in range(1, 300)],
        "population_a string, population_b string, chrom string, pos long, n_a long, x_a long, n_b long, x_b long",
    )
    by_cell = resample.resample_blocks(resample.block_spectra(shared, 20, 4, 4), 5, 1).collect()
    blocks = resample.block_configurations(shared, 20)
    by_configuration = resample.resample_block_configurations(blocks, 5, 1, 4, 4).collect()
    one, two = ({(r["replicate"], r["i"], r["j"]): r["mass"] for r in rows if r["mass"] > 1e-12} for rows in (by_cell, by_configuration))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_summary_needs_two_finite_estimates(spark):
    rows = [("A", "B", 0, 0.1, 0.2), ("A", "B", 1, float("nan"), 0.2)]
    estimates = spark.createDataFrame(rows, "population_a string, population_b string, replicate int, m_a_to_b double, m_b_to_a double")
    with pytest.raises(Exception, match="only one replicate, or none"):
        resample.bootstrap_summary(estimates).collect()
    assert resample.bootstrap_summary(estimates, on_too_few="drop").count() == 0
