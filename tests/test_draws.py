"""Counter-based draws: Poisson block weights and multinomial trees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftway.operators import draws, resample, spectra
from driftway.operators.spectra import PAIR


def shared_loci(spark, loci=600):
    return spark.createDataFrame(
        [("A", "B", str(p % 3), p, 4 + p % 2, p % 5, 4, (3 * p) % 5) for p in range(1, loci)],
        "population_a string, population_b string, chrom string, pos long, n_a long, x_a long, n_b long, x_b long",
    )


def test_poisson_ends_invert_the_distribution():
    ends = [end / 2**48 for end in resample.poisson_ends()]
    total = 0.0
    for k, end in enumerate(ends):
        total += math.exp(-1) / math.factorial(k)
        assert end == pytest.approx(total, abs=1e-13)


def test_poisson_weights_have_mean_and_variance_one(spark):
    units = spark.range(4000).select(F.col("id").cast("string").alias("block"))
    replicates = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("replicate")
    weights = units.select("block", replicates).withColumn(
        "w", resample.poisson_weight(resample.unit_draw(7, F.col("replicate"), "block"))
    )
    row = weights.agg(F.avg("w").alias("mean"), F.var_samp("w").alias("variance"), F.avg((F.col("w") == 0).cast("int")).alias("none")).first()
    assert row["mean"] == pytest.approx(1.0, abs=0.02) and row["variance"] == pytest.approx(1.0, abs=0.04)
    assert row["none"] == pytest.approx(math.exp(-1), abs=0.01)
    one, two = (weights.filter(F.col("replicate") == k).select("block", F.col("w").alias(f"w{k}")) for k in (0, 1))
    assert abs(one.join(two, "block").agg(F.corr("w0", "w1")).first()[0]) < 0.06


def test_poisson_mode_agrees_with_exact_draws_in_distribution(spark):
    shared = shared_loci(spark)
    blocks = resample.block_configurations(shared, 20)
    n = blocks.select("chrom", "block").distinct().count()
    replicates = 200
    sums = []
    for drawn in (
        resample.resample_block_configurations(blocks, replicates, 3, 4, 4), resample.poisson_block_configurations(blocks, replicates, 3, 4, 4)
    ):
        rows = drawn.groupBy("replicate").agg(F.sum("mass").alias("m"), F.sum(F.col("i") * F.col("mass")).alias("s")).collect()
        assert len(rows) == replicates
        sums.append(np.array([(r["m"], r["s"] / r["m"]) for r in rows]))
    exact, poisson = sums
    assert poisson[:, 0].mean() == pytest.approx(exact[:, 0].mean(), rel=4 / math.sqrt(n * replicates))
    # totals vary as n independent Poisson weights do; the estimate varies as under exact draws
    assert poisson[:, 0].std() / exact[:, 0].mean() == pytest.approx(1 / math.sqrt(n), rel=0.3)
    assert poisson[:, 1].mean() == pytest.approx(exact[:, 1].mean(), rel=0.01)
    assert poisson[:, 1].std() == pytest.approx(exact[:, 1].std(), rel=0.3)


def test_poisson_draws_ignore_other_pairs_and_partitions(spark):
    shared = shared_loci(spark)
    other = shared.withColumn("population_b", F.lit("C"))
    found = []
    for table in (shared, shared.unionByName(other).repartition(7)):
        drawn = resample.poisson_block_configurations(resample.block_configurations(table, 20), 18, 3, 4, 4)
        rows = drawn.filter("population_b = 'B'").collect()
        found.append({(r["replicate"], r["i"], r["j"]): round(r["mass"], 9) for r in rows})
    assert found[0] == found[1] and {k[0] for k in found[0]} == set(range(18))
    offsets = shared.select(*PAIR).distinct().withColumn("seed_offset", F.lit(5).cast("long"))
    moved = resample.poisson_block_configurations(resample.block_configurations(shared, 20), 18, 3, 4, 4, offsets=offsets)
    plain = resample.poisson_block_configurations(resample.block_configurations(shared, 20), 18, 8, 4, 4)
    moved, plain = ({(r["replicate"], r["i"], r["j"]): round(r["mass"], 9) for r in drawn.collect()} for drawn in (moved, plain))
    assert moved == plain != found[0]
    with pytest.raises(ValueError):
        resample.poisson_block_configurations(resample.block_configurations(shared, 20), 1, 3, 4, 4)
    assert spectra.configurations(shared).count() > 0


def test_binomial_inversion_against_sums():
    rng = np.random.default_rng(2)
    n, p, u = rng.integers(0, 4000, 300), rng.random(300), rng.random(300)
    n[:20], p[20:30], p[30:40] = 1, 0.0, 1.0
    got = draws.binomial(n, p, u)
    for size, share, at, k in zip(n.tolist(), p.tolist(), u.tolist(), got.tolist()):
        if share in (0.0, 1.0):
            assert k == size * share
            continue
        logs = [math.lgamma(size + 1) - math.lgamma(x + 1) - math.lgamma(size - x + 1) + x * math.log(share) + (size - x) * math.log(1 - share) for x in range(size + 1)]
        sums = np.cumsum(np.exp(logs))
        assert k == int((sums < at).sum())
    large = draws.binomial(np.full(500, 10**9), np.full(500, 0.25), rng.random(500))
    assert large.mean() == pytest.approx(2.5e8, abs=4 * 13693 / math.sqrt(500))


def test_tree_draws_do_not_depend_on_the_size_of_buckets(spark):
    units = spark.createDataFrame([("k", u, 1 + u % 4) for u in range(300)] + [("l", u, 2) for u in range(3)], "k string, unit int, n int")
    found = [
        sorted(map(tuple, draws.multinomial_weights(units.repartition(parts), ["k"], ["unit"], "n", 20, 3, bucket_bits=bits).collect()))
        for bits, parts in ((2, 3), (5, 1), (12, 8))
    ]
    assert found[0] == found[1] == found[2]
    totals = {}
    for k, _, replicate, weight in found[0]:
        totals[k, replicate] = totals.get((k, replicate), 0) + weight
    assert totals == {(k, r): n for r in range(20) for k, n in (("k", sum(1 + u % 4 for u in range(300))), ("l", 6))}


def test_tree_draws_are_multinomial(spark):
    """Means, variances and covariances of the weights over many replicates."""
    counts = [1, 7, 2, 30, 4, 11]
    units = spark.createDataFrame(list(enumerate(counts)), "unit int, n int")
    replicates, n = 3000, sum(counts)
    rows = draws.multinomial_weights(units, [], ["unit"], "n", replicates, 11, bucket_bits=1).collect()
    table = np.zeros((replicates, len(counts)))
    for r in rows:
        table[r["replicate"], r["unit"]] = r["weight"]
    assert (table.sum(axis=1) == n).all()
    share = np.array(counts) / n
    assert np.allclose(table.mean(axis=0), counts, atol=5 * np.sqrt(np.array(counts) / replicates))
    want = n * (np.diag(share) - np.outer(share, share))
    assert np.allclose(np.cov(table.T), want, atol=0.9)
