import math

import pytest
from pyspark.sql import functions as F

from driftway.functions import special
from driftway.operators import models, transition

KEYS = ["p"]


def scores(spark, rows):
    return spark.createDataFrame(rows, "p int, model string, log_likelihood double, parameters int, observations int")


def test_aic_ranking(spark):
    table = scores(spark, [(1, "b", -100.0, 5, 40), (1, "a", -101.0, 4, 40), (1, "c", -120.0, 3, 40)])
    rows = {r["model"]: r for r in models.rank_models(table, KEYS, use_aicc=False).collect()}
    assert rows["b"]["aic"] == 210.0 and rows["a"]["aic"] == 210.0
    assert rows["a"]["model_rank"] == 1  # equal criteria order by name
    assert sum(r["akaike_weight"] for r in rows.values()) == pytest.approx(1.0)


def test_aicc_is_infinite_with_few_observations(spark):
    rows = models.rank_models(scores(spark, [(1, "a", -10.0, 5, 6), (1, "b", -10.0, 3, 6)]), KEYS).collect()
    by = {r["model"]: r for r in rows}
    assert by["a"]["aicc"] == math.inf and by["a"]["akaike_weight"] == 0.0 and by["b"]["akaike_weight"] == 1.0
    none = models.rank_models(scores(spark, [(1, "a", -10.0, 5, 6)]), KEYS).first()
    assert none["akaike_weight"] == 0.0


def test_best_model_direction(spark):
    ranking = models.rank_models(
        scores(spark, [(1, "asymmetric_migration", -1.0, 5, 40), (2, "isolation", -1.0, 3, 40)]), KEYS, use_aicc=False
    )
    best = {r["p"]: r["directional_model"] for r in models.best_models(ranking, KEYS).collect()}
    assert best == {1: "asymmetric_migration", 2: None}


def runs(spark, rows):
    return spark.createDataFrame(rows, "p int, run int, success boolean, log_likelihood double, params map<string,double>")


def test_multistart(spark):
    table = runs(
        spark,
        [
            (1, 1, True, -10.0, {"m": 1.0}), (1, 2, True, -10.5, {"m": 1.2}), (1, 3, True, -11.0, {"m": 9.0}),
            (1, 4, False, float("-inf"), {"m": None}), (2, 1, True, -5.0, {"m": 1.0}), (2, 2, True, -9.0, {"m": 1.0}),
            (3, 1, True, -5.0, {"m": 1.0}), (3, 2, True, -5.0, {"m": 8.0}),
        ],
    )
    got = {r["p"]: r for r in models.multistart_summary(table, KEYS).collect()}
    assert got[1]["stable"] and got[1]["converged_fraction"] == 0.75 and got[1]["near_best_runs"] == 2
    assert not got[2]["stable"] and got[2]["largest_spread"] == math.inf
    assert not got[3]["stable"] and got[3]["best_run"] == 1 and got[3]["best_params"] == {"m": 1.0}
    failed = runs(spark, [(1, 1, False, float("-inf"), {"m": None})])
    with pytest.raises(Exception, match="no start of a model's fit succeeded"):
        models.multistart_summary(failed, KEYS).collect()
    assert models.multistart_summary(failed, KEYS, on_all_failed="drop").count() == 0


def test_multistart_hot_key(spark):
    table = spark.range(20000).select(
        F.lit(1).alias("p"), F.col("id").alias("run"), F.lit(True).alias("success"),
        (-F.col("id") / 10000).alias("log_likelihood"), F.create_map(F.lit("m"), F.lit(1.0) + F.col("id") / 1e6).alias("params"),
    )
    row = models.multistart_summary(table, KEYS).first()
    assert row["near_best_runs"] == 5000 and row["best_run"] == 0 and row["stable"]


def brute_ll(data, model):
    theta = sum(data.values()) / sum(model.values())
    return sum(
        -theta * m + data.get(c, 0.0) * math.log(theta * m) - math.lgamma(data.get(c, 0.0) + 1) for c, m in model.items()
    )


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_library_scan_against_brute_force(spark, broadcast_rows):
    size = 3
    inner = [(i, j) for i in range(size + 1) for j in range(size + 1) if (i, j) not in ((0, 0), (size, size))]
    data = {c: float((c[0] * 5 + c[1] * 3) % 4) for c in inner}
    library = {k: {(i, j): 1.0 / (1 + k + i + 2 * j) for i, j in inner} for k in range(3)}
    cells = spark.createDataFrame([(1, i, j, m) for (i, j), m in data.items()], "p int, i long, j long, mass double")
    entries = spark.createDataFrame(
        [("asymmetric_migration", k, i, j, m) for k, table in library.items() for (i, j), m in table.items()],
        "model string, param_id int, i long, j long, expected double",
    )
    scan = models.library_scan(cells, entries, size, size, KEYS, polarized=True, max_broadcast_rows=broadcast_rows)
    got = {r["param_id"]: r["log_likelihood"] for r in scan.collect()}
    for k, table in library.items():
        assert got[k] == pytest.approx(brute_ll(data, table), rel=1e-10)
    best = models.best_entries(scan, KEYS).first()
    assert got[best["param_id"]] == max(got.values())
    holed = entries.filter("NOT (param_id = 0 AND i = 1 AND j = 0)")
    worst = models.library_scan(cells, holed, size, size, KEYS, polarized=True).filter("param_id = 0").first()
    assert worst["log_likelihood"] == -math.inf


def test_folded_scan_depends_on_folded_cells_only(spark):
    size = 2
    cells = [(1, i, j, float(i + 2 * j)) for i in range(3) for j in range(3)]
    mirrored = [(1, size - i, size - j, m) for _, i, j, m in cells]
    entries = spark.createDataFrame(
        [("isolation", 0, i, j, 1.0 + i) for i in range(3) for j in range(3)],
        "model string, param_id int, i long, j long, expected double",
    )
    values = []
    for rows in (cells, mirrored):
        table = spark.createDataFrame(rows, "p int, i long, j long, mass double")
        values.append(models.library_scan(table, entries, size, size, KEYS).first()["log_likelihood"])
    assert values[0] == pytest.approx(values[1])


def test_profile_interval(spark):
    rows = [(1, 0.25, -105.0), (1, 0.5, -101.5), (1, 1.0, -100.0), (1, 2.0, -101.8), (1, 4.0, -110.0), (1, 9.0, float("nan")), (2, 1.0, float("-inf"))]
    table = spark.createDataFrame(rows, "p int, fixed_value double, log_likelihood double")
    got = {r["p"]: (r["lower"], r["upper"]) for r in models.profile_interval(table, KEYS).collect()}
    assert got == {1: (0.5, 2.0), 2: (None, None)}
    deltas = models.profile_deltas(table.filter("p = 1"), KEYS).filter("fixed_value = 2.0").first()
    assert deltas["delta_log_likelihood"] == pytest.approx(1.8)


def test_profile_grid(spark):
    start = spark.createDataFrame([(0.7,)], "mle double")
    values = sorted(r["fixed_value"] for r in special.profile_grid(start, lower=0.001, upper=5.0, points=7).collect())
    assert 0.7 in values and values[0] == pytest.approx(0.07) and values[-1] == pytest.approx(5.0)
    for options in ({"lower": 0, "upper": 1}, {"lower": 0.1, "upper": 1, "points": 4}, {"lower": 0.1, "upper": 1, "fold_range": 1}):
        with pytest.raises(ValueError):
            special.profile_grid(start, **options)


def test_model_specs(spark):
    specs = models.model_specs(spark)
    assert specs.groupBy("model").count().count() == 5
    assert specs.filter("model = 'secondary_contact_asymmetric'").count() == 6
    assert specs.filter("NOT (lower < initial AND initial < upper)").count() == 0


def frequencies(spark, n, m_ab, m_ba):
    rows = []
    for k in range(n):
        a, b = (k * 37 % 97 + 1) / 99, (k * 53 % 89 + 1) / 91
        rows.append((a, b, (1 - m_ba) * a + m_ba * b, (1 - m_ab) * b + m_ab * a))
    return spark.createDataFrame(rows, "p_a_initial double, p_b_initial double, p_a_final double, p_b_final double")


@pytest.mark.parametrize("m_ab, m_ba", [(0.08, 0.02), (0.0, 0.3), (1.0, 0.0)])
def test_one_generation_recovers_rates(spark, m_ab, m_ba):
    row = transition.estimate_one_generation(frequencies(spark, 400, m_ab, m_ba), 100_000, 100_000).first()
    assert row["m_a_to_b"] == pytest.approx(m_ab, abs=2e-4) and row["m_b_to_a"] == pytest.approx(m_ba, abs=2e-4)
    assert row["success"]


def test_one_generation_is_the_maximum(spark):
    loci = frequencies(spark, 100, 0.1, 0.05)
    row = transition.estimate_one_generation(loci, 50, 80).first()
    near = [row["m_a_to_b"] + d for d in (-1e-3, 0.0, 1e-3)]
    scan = transition.transition_scan(loci, 50, 80, near).filter("direction = 'a_to_b'").orderBy("m").collect()
    assert scan[1]["log_likelihood"] >= max(scan[0]["log_likelihood"], scan[2]["log_likelihood"])


def test_one_generation_bootstrap(spark):
    loci = frequencies(spark, 200, 0.08, 0.02)
    row = transition.bootstrap_one_generation(loci, 500, 500, replicates=8, seed=4).first()
    assert row["probability_a_to_b_stronger"] == 1.0 and row["replicates"] == 8
    assert row["m_a_to_b_lower"] <= row["m_a_to_b_mean"] <= row["m_a_to_b_upper"]
    assert row["m_a_to_b_mean"] == pytest.approx(0.08, abs=0.01)


def test_transition_errors(spark):
    loci = frequencies(spark, 3, 0.1, 0.1)
    with pytest.raises(ValueError, match="has to be above zero"):
        transition.estimate_one_generation(loci, 0, 10)
    with pytest.raises(Exception, match=r"p_a_final has a value that is no allele frequency"):
        transition.estimate_one_generation(loci.withColumn("p_a_final", F.lit(1.2)), 10, 10)
    with pytest.raises(ValueError):
        transition.bootstrap_one_generation(loci, 10, 10, replicates=1)


def test_an_outlier_does_not_fill_one_slot(spark):
    from pyspark.sql import functions as F

    from driftway.operators import ranking

    rows = [("k", float(v)) for v in range(4000)] + [("k", 1e15)]
    table = spark.createDataFrame(rows, "k string, v double")
    tallies = table.groupBy("k", "v").agg(F.count("*").alias("n"))
    shares = [k / ranking.BUCKETS for k in range(1, ranking.BUCKETS)]
    edges = tallies.groupBy("k").agg(F.percentile_approx("v", shares, 20 * ranking.BUCKETS).alias("e"))
    slots = tallies.join(edges, "k").groupBy(F.size(F.filter("e", lambda e: e < F.col("v"))).alias("slot")).count().collect()
    assert max(r["count"] for r in slots) <= 3 * 4001 / ranking.BUCKETS
    found = ranking.linear_quantiles(table, ["k"], "v", {"low": 0.25, "mid": 0.5, "top": 1.0}).first()
    assert (found["low"], found["mid"], found["top"]) == (1000.0, 2000.0, 1e15)


def test_searches_take_a_fixed_number_of_passes(spark):
    """All brackets narrow inside one plan: the number of jobs does not depend on replicates or on how hard the search is."""
    from driftway.operators.transition import _PASSES, bootstrap_estimates

    counts = []
    for replicates in (2, 12):
        group = f"search-{replicates}"
        spark.sparkContext.setJobGroup(group, "search")
        found = bootstrap_estimates(frequencies(spark, 60, 0.3, 0.001), 40, 70, replicates=replicates, seed=2)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        rows = found.collect()
        after = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        assert len(rows) == replicates and all(0 <= r["m_a_to_b"] <= 1 for r in rows)
        counts.append(after - before)
    spark.sparkContext.setJobGroup("", "")
    # a pass is one aggregate: two shuffles of a few rows and a broadcast
    assert counts[0] == counts[1] <= 3 * (_PASSES + 1)


def test_searches_reach_the_maximum_from_any_side(spark):
    for m_ab, m_ba in ((1e-4, 0.999), (0.5, 0.5), (0.031, 0.0007)):
        loci = frequencies(spark, 80, m_ab, m_ba)
        row = transition.estimate_one_generation(loci, 30, 30).first()
        for name, direction in (("m_a_to_b", "a_to_b"), ("m_b_to_a", "b_to_a")):
            near = [min(max(row[name] + d, 0.0), 1.0) for d in (-1e-6, 0.0, 1e-6)]
            scan = transition.transition_scan(loci, 30, 30, near).filter(F.col("direction") == direction).orderBy("m").collect()
            top = max(r["log_likelihood"] for r in scan)
            assert next(r["log_likelihood"] for r in scan if r["m"] == near[1]) >= top - 1e-9 * abs(top)
