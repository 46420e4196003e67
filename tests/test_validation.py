import json

import pytest
from pyspark.sql import functions as F

from driftway.operators import comparison, gates, metrics, ranking, regimes, summaries, thresholds

EVIDENCE = "truth_direction string, preferred_direction string, asymmetric_model_weight double, directional_support double, asymmetry_index double, optimizer_stable boolean, interval_separated boolean"
EVIDENCE_ROWS = [
    ("symmetric", "A->B", 0.8, 0.96, 0.5, True, True),
    ("none", "symmetric", 0.2, 0.5, 0.0, True, False),
    ("A->B", "A->B", 0.95, 0.99, 0.6, True, True),
    ("A->B", "A->B", 0.92, 0.98, 0.5, True, True),
    ("B->A", "B->A", 0.95, 0.99, -0.6, True, True),
    ("B->A", "A->B", 0.91, 0.97, 0.4, True, True),
]


def test_threshold_rates(spark):
    table = spark.createDataFrame(EVIDENCE_ROWS, EVIDENCE)
    row = thresholds.evaluate_thresholds(table, 0.7, 0.95, 0.25).first()
    assert row["false_directional_positive_rate"] == 0.5 and row["directional_sensitivity"] == 0.75
    assert row["direction_accuracy_when_called"] == 0.75 and row["evaluated_rows"] == 6
    chosen, scan = thresholds.calibrate_thresholds(table, 0.0)
    assert scan.count() == 100 and chosen.first()["min_model_weight"] == 0.9
    with pytest.raises(Exception, match="no combination of thresholds"):
        thresholds.select_thresholds(scan.filter("called_fraction = 0"), 0.0).collect()


@pytest.mark.parametrize(
    "column, value, message",
    [
        ("truth_direction", "A=>B", "truth_direction has a label"), ("preferred_direction", "up", "preferred_direction has a label"),
        ("asymmetric_model_weight", None, "lacks a value"), ("asymmetric_model_weight", "x", "lacks a value"),
        ("directional_support", 1.2, "directional_support is outside"), ("asymmetry_index", -1.5, "asymmetry_index is outside"),
        ("optimizer_stable", "perhaps", "neither true nor false"),
    ],
)
def test_evidence_is_strict(spark, column, value, message):
    table = spark.createDataFrame(EVIDENCE_ROWS[:1], EVIDENCE).withColumn(column, F.lit(value).cast("string"))
    with pytest.raises(Exception, match=message):
        thresholds.validate_evidence(table).collect()


def test_text_false_is_false(spark):
    table = spark.createDataFrame(EVIDENCE_ROWS, EVIDENCE).withColumn("optimizer_stable", F.lit("False"))
    assert thresholds.evaluate_thresholds(table, 0.5, 0.5, 0.1).first()["called_fraction"] == 0.0


RECOVERY = "scenario string, expected_direction string, success string, true_m_a_to_b double, true_m_b_to_a double, estimated_m_a_to_b double, estimated_m_b_to_a double, optimizer_stable boolean"
RECOVERY_ROWS = [
    ("sym", "symmetric", "true", 0.5, 0.5, 0.5, 0.5, True), ("sym", "symmetric", "true", 0.5, 0.5, 0.9, 0.1, True),
    ("sym", "symmetric", "true", 0.5, 0.5, 0.5, 0.45, False), ("sym", "symmetric", "1", 0.5, 0.5, 0.5, 0.5, True),
    ("sym", "symmetric", "no", 0.5, 0.5, None, None, False),
    ("ab", "A->B", "yes", 1.0, 0.25, 1.5, 0.25, True), ("ab", "A->B", "yes", 1.0, 0.25, 0.5, 0.75, True),
    ("bad", "B->A", "0", 0.1, 2.0, None, None, False),
]


def test_recovery(spark):
    got = {r["scenario"]: r for r in summaries.summarize_recovery(spark.createDataFrame(RECOVERY_ROWS, RECOVERY)).collect()}
    assert got["sym"]["false_directional_positive_rate"] == 0.25 and got["sym"]["success_rate"] == 0.8
    assert got["sym"]["optimizer_stable_rate"] == 0.75
    assert got["ab"]["bias_m_a_to_b"] == 0.0 and got["ab"]["rmse_m_a_to_b"] == 0.5
    assert got["ab"]["direction_accuracy"] == 0.5 and got["ab"]["false_directional_positive_rate"] is None
    assert got["bad"]["successful_replicates"] == 0 and got["bad"]["bias_m_a_to_b"] is None


@pytest.mark.parametrize(
    "row, message",
    [
        (("ab", "A->B", "yes", 2.0, 0.25, 1.0, 0.2, True), "different truths"),
        (("new", "B->A", "yes", 2.0, 0.25, 1.0, 0.2, True), "expected_direction disagrees"),
        (("ab", "A->B", "yes", 1.0, 0.25, None, 0.2, True), "of a successful fit is not a finite"),
        (("ab", "A->B", "yes", -1.0, 0.25, 1.0, 0.2, True), "true_m_a_to_b has a value"),
        (("ab", "A->B", "Falsey", 1.0, 0.25, 1.0, 0.2, True), "neither true nor false"),
    ],
)
def test_recovery_rejects(spark, row, message):
    with pytest.raises(Exception, match=message):
        summaries.summarize_recovery(spark.createDataFrame([*RECOVERY_ROWS, row], RECOVERY)).collect()


def test_stress(spark):
    rows = [
        ("null", "symmetric", True, True, False, "none"), ("null", "symmetric", True, True, True, "A->B"),
        ("null", "symmetric", True, True, False, "none"), ("null", "symmetric", True, False, False, "none"),
        ("dir", "A->B", True, True, True, "A->B"), ("dir", "A->B", True, True, True, "B->A"), ("dir", "A->B", False, False, False, None),
    ]
    table = spark.createDataFrame(rows, "scenario string, expected_direction string, success boolean, correct_model_selected boolean, provisional_directional_signal boolean, preferred_direction string")
    got = {r["scenario"]: r for r in summaries.summarize_stress(table).collect()}
    assert got["null"]["correct_model_selection_rate"] == 0.75 and got["null"]["false_direction_signal_rate"] == 0.25
    assert got["dir"]["direction_recovery_rate"] == 0.5 and got["dir"]["false_direction_signal_rate"] is None


def test_signal_without_directional_model(spark):
    table = spark.createDataFrame(
        [(1, None, 0.9, True, 1.0, 0.1), (2, "asymmetric_migration", 0.9, True, 1.0, 0.1)],
        "id int, directional_model string, best_weight double, stable boolean, m_a_to_b double, m_b_to_a double",
    )
    got = {r["id"]: r for r in summaries.provisional_signal(table).collect()}
    assert got[1]["preferred_direction"] == "none" and not got[1]["provisional_directional_signal"]
    assert got[1]["asymmetric_model_weight"] == 0.0
    assert got[2]["preferred_direction"] == "A->B" and got[2]["provisional_directional_signal"]


def test_linkage(spark):
    schema = "scenario string, method string, expected_direction string, success boolean, true_m_a_to_b double, true_m_b_to_a double, m_a_to_b_mean double, m_b_to_a_mean double, m_a_to_b_lower double, m_a_to_b_upper double, m_b_to_a_lower double, m_b_to_a_upper double, preferred_direction_support double"
    rows = [
        ("symmetric", "block_5", "symmetric", True, 0.5, 0.5, 0.9, 0.3, 0.4, 0.6, 0.1, 0.2, 0.99),
        ("symmetric", "block_5", "symmetric", True, 0.5, 0.5, 0.5, 0.5, 0.4, 0.8, 0.4, 0.6, 0.5),
        ("symmetric", "block_5", "symmetric", False, 0.5, 0.5, None, None, None, None, None, None, None),
    ]
    row = summaries.summarize_linkage(summaries.coverage_rows(spark.createDataFrame(rows, schema))).first()
    assert (row["coverage_a_to_b"], row["coverage_b_to_a"]) == (1.0, 0.5)
    assert row["mean_interval_width_a_to_b"] == pytest.approx(0.3)
    assert row["strong_directional_support_rate"] == row["false_directional_support_rate"] == 0.5
    assert row["success_rate"] == pytest.approx(2 / 3)


def test_metrics(spark):
    table = spark.createDataFrame([(1.0, 0.9, 0.8, 1.2), (2.0, 2.1, 2.05, 2.2), (3.0, 3.0, 2.0, 4.0)], "t double, e double, lo double, hi double")
    row = metrics.parameter_errors(table, [], "t", "e").first()
    assert row["bias"] == pytest.approx(0.0) and row["rmse"] == pytest.approx((0.02 / 3) ** 0.5)
    assert metrics.interval_coverage(table, [], "t", "lo", "hi").first()[0] == pytest.approx(2 / 3)
    rates = spark.createDataFrame([(1.0, 0.6), (1.0, 1.0), (0.0, 0.0), (1.0, 0.9)], "ab double, ba double")
    assert metrics.false_direction_rate(rates, [], ("ab", "ba")).first()[0] == 0.25
    with pytest.raises(Exception, match="no rows to validate"):
        metrics.parameter_errors(table.filter("false"), [], "t", "e").collect()
    with pytest.raises(Exception, match="ends below its start"):
        metrics.interval_coverage(table.withColumn("lo", F.lit(9.0)), [], "t", "lo", "hi").collect()
    with pytest.raises(ValueError, match="tolerance"):
        metrics.direction_accuracy(table, [], ("t", "e", "lo", "hi"), tolerance=-1)


GRID = "chromosomes int, segregating_sites int, scenario string, expected_direction string, success_rate double, direction_accuracy double, false_directional_positive_rate double"


def grid(spark, cells):
    rows = []
    for n, sites, accuracy, false in cells:
        rows += [(n, sites, "s", "symmetric", 1.0, None, false), (n, sites, "ab", "A->B", 1.0, accuracy, None)]
    return spark.createDataFrame(rows, GRID)


def test_regimes(spark):
    table = regimes.data_regimes(grid(spark, [(10, 1000, 0.8, 0.0), (20, 1000, 0.95, 0.01), (10, 5000, 0.95, 0.05), (20, 5000, 0.99, 0.0), (40, 5000, 0.99, 0.2)]))
    front = regimes.pareto_minimum(table)
    assert {(r["chromosomes"], r["segregating_sites"]) for r in front.collect()} == {(10, 5000), (20, 1000)}
    row = regimes.recommend_requirements(table, front).first()
    assert (row["tested_regimes"], row["passing_regimes"], row["status"]) == (5, 3, "recommendations_available")
    none = table.filter("NOT passes_targets")
    assert regimes.recommend_requirements(none, regimes.pareto_minimum(none)).first()["status"] == "no_tested_regime_met_targets"
    with pytest.raises(Exception, match="unknown expected_direction"):
        regimes.data_regimes(grid(spark, [(1, 1, 1.0, 0.0)]).withColumn("expected_direction", F.lit("up"))).collect()


def test_pareto_against_brute_force(spark):
    rows = [(k * 37 % 101, k * 53 % 997 + 1, k % 5 != 0) for k in range(200)]
    table = spark.createDataFrame(rows, "chromosomes int, segregating_sites int, passes_targets boolean")
    good = [(c, s) for c, s, ok in rows if ok]
    want = {(c, s) for c, s in good if not any(a <= c and b <= s and (a < c or b < s) for a, b in good)}
    assert {(r[0], r[1]) for r in regimes.pareto_minimum(table).collect()} == want


METHOD = "scenario string, replicate int, truth_m_a_to_b double, truth_m_b_to_a double, estimated_m_a_to_b double, estimated_m_b_to_a double"


def method(spark, *changes, estimand=None):
    rows = [("sym", 1, 0.5, 0.5, 0.5, 0.5), ("sym", 2, 0.5, 0.5, 0.9, 0.1), ("ab", 1, 1.0, 0.2, 0.8, 0.3), *changes]
    table = spark.createDataFrame(rows, METHOD)
    return table if estimand is None else table.withColumn("estimand", F.lit(estimand)).withColumn("method_version", F.lit(" 2 "))


def test_comparison(spark):
    both = comparison.matched_comparison(comparison.combine_methods({"x": method(spark), "y": method(spark)}))
    got = {(r["method"], r["scenario"]): r for r in comparison.summarize_methods(both).collect()}
    assert got["x", "sym"]["false_directional_positive_rate"] == 0.5 and got["x", "sym"]["direction_accuracy"] == 0.5
    assert got["y", "ab"]["false_directional_positive_rate"] is None and got["y", "ab"]["bias_m_a_to_b"] == pytest.approx(-0.2)
    short = comparison.summarize_methods(both, direction_only=True)
    assert "bias_m_a_to_b" not in short.columns
    pivot = comparison.method_pivot(comparison.summarize_methods(both)).first()
    assert (pivot["scenario"], pivot["x"], pivot["y"]) == ("ab", 1.0, 1.0)


def test_comparison_rejects(spark):
    with pytest.raises(ValueError, match="two methods or more"):
        comparison.combine_methods({"x": method(spark)})
    with pytest.raises(ValueError, match="several rows for one replicate"):
        comparison.validate_method_table(method(spark, ("sym", 1, 0.5, 0.5, 0.1, 0.1)), "x")
    with pytest.raises(ValueError, match="no row that can be compared"):
        comparison.validate_method_table(method(spark).filter("false"), "x")
    with pytest.raises(Exception, match="below zero"):
        comparison.validate_method_table(method(spark, ("n", 1, -0.5, 0.5, 0.1, 0.1)), "x").collect()
    more = {"x": method(spark), "y": method(spark, ("new", 1, 1.0, 0.2, 0.8, 0.3))}
    with pytest.raises(ValueError, match=r"replicates of y are not those of x: it lacks \[\] and has \[\('new', 1\)\]"):
        comparison.matched_comparison(comparison.combine_methods(more))
    assert comparison.matched_comparison(comparison.combine_methods(more), require_complete_match=False).count() == 7
    other = {"x": method(spark), "y": method(spark).withColumn("truth_m_a_to_b", F.lit(0.7))}
    with pytest.raises(ValueError, match="another truth under another method"):
        comparison.matched_comparison(comparison.combine_methods(other))
    mixed = comparison.combine_methods({"x": method(spark, estimand="a"), "y": method(spark, estimand=" b ")})
    with pytest.raises(ValueError, match="different quantities: a, b"):
        comparison.matched_comparison(mixed)
    assert comparison.matched_comparison(mixed, allow_mixed_estimands=True).count() == 6
    row = comparison.comparison_metadata(mixed, direction_only=True).first()
    assert row["estimands"] == ["a", "b"] and row["method_versions"] == {"x": ["2"], "y": ["2"]}


def campaign(spark, root, skip=()):
    def csv(path, df):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        df.toPandas().to_csv(target, index=False)

    def record(path, value):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(value))

    parts = {
        "recovery": lambda: csv("recovery_grid/recovery_grid_summary.csv", grid(spark, [(20, 1000, 0.95, 0.01)])),
        "thresholds": lambda: csv("threshold_calibration/selected_thresholds.csv", spark.createDataFrame([(0.01, 0.9, 0.95)], "false_directional_positive_rate double, directional_sensitivity double, direction_accuracy_when_called double")),
        "linkage": lambda: csv("mechanistic_linkage/mechanistic_linkage_summary.csv", spark.createDataFrame([("locus", 0.1, 0.1, 0.1), ("block_5", 1.0, 0.95, 0.93)], "method string, success_rate double, coverage_a_to_b double, coverage_b_to_a double")),
        "methods": lambda: csv("external_comparison/method_comparison_summary.csv", spark.createDataFrame([("Driftway", "s", 3), ("other", "s", 3)], "method string, scenario string, replicates int")),
        "metadata": lambda: record("external_comparison/comparison_metadata.json", {"require_complete_match": True, "direction_only": False, "estimands": ["m"], "method_versions": {"other": ["1"]}}),
        "requirements": lambda: record("data_requirements/data_requirements.json", {"status": "recommendations_available", "passing_regimes": 3, "pareto_minimum_regimes": [{"chromosomes": 20, "segregating_sites": 1000}]}),
    }
    for name, make in parts.items():
        if name not in skip:
            make()
    return str(root)


def test_campaign_passes(spark, tmp_path):
    checks, summary = gates.review_campaign(spark, campaign(spark, tmp_path))
    row = summary.first()
    assert row["release_ready"] and row["checks_total"] == 15, checks.filter("NOT passed").collect()


@pytest.mark.parametrize(
    "missing, metric",
    [("recovery", "study_completed"), ("linkage", "study_completed"), ("metadata", "comparison_provenance"), ("requirements", "study_completed")],
)
def test_missing_study_blocks(spark, tmp_path, missing, metric):
    _, summary = gates.review_campaign(spark, campaign(spark, tmp_path, skip=(missing,)))
    row = summary.first()
    assert not row["release_ready"] and [b["metric"] for b in row["blockers"]] == [metric]


def test_gate_rules(spark):
    criteria = gates.Criteria()
    table = grid(spark, [(20, 1000, 0.95, 0.01)])
    with pytest.raises(Exception, match="direction_accuracy must be a finite share"):
        gates.review_recovery_grid(table.withColumn("direction_accuracy", F.lit("x")), criteria).collect()
    with pytest.raises(Exception, match="other than the known"):
        gates.review_recovery_grid(table.withColumn("expected_direction", F.lit("none")), criteria).collect()
    only_null = gates.review_recovery_grid(table.filter("scenario = 's'"), criteria).filter("metric = 'minimum_direction_accuracy'").first()
    assert only_null["passed"] is None and only_null["observed"] is None
    with pytest.raises(ValueError, match="lies above"):
        gates.Criteria(min_ci_coverage=0.99, max_ci_coverage=0.9).checked()
    rows = spark.createDataFrame([("locus", 1.0, 0.9, 0.9)], "method string, success_rate double, coverage_a_to_b double, coverage_b_to_a double")
    assert gates.review_linkage(rows, criteria).first()["metric"] == "block_results_present"
    methods = spark.createDataFrame([("driftway", "s", 3)], "method string, scenario string, replicates int")
    with pytest.raises(ValueError, match="neither true nor false"):
        gates.review_comparison(methods, {"require_complete_match": "yes"})
    assert not gates.review_comparison(methods, None).filter("passed").count()


def test_quantiles_match_numpy(spark):
    import numpy as np

    values = [float((k * 7919) % 1000) for k in range(997)] + [5.0] * 500
    table = spark.createDataFrame([(1, v) for v in values] + [(2, 3.0)], "g int, v double")
    got = {r["g"]: r for r in ranking.linear_quantiles(table, ["g"], "v", {"low": 0.025, "mid": 0.5, "high": 0.975}).collect()}
    for name, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975)):
        assert got[1][name] == pytest.approx(float(np.quantile(values, q)))
        assert got[2][name] == 3.0


def test_bucketed_rank_is_a_row_number(spark):
    table = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    ranked = ranking.bucketed_rank(table, ["g"], [F.floor(F.col("v") / 10)], [F.col("v")])
    for g in range(3):
        rows = ranked.filter(F.col("g") == g).orderBy("v").collect()
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_key_sets_of_many_methods_take_one_job(spark):
    """70 methods need two longs of bits; which keys are missing where is found with as many jobs as for two."""
    rows = [(f"m{m:02d}", "s", k, 0.5, 0.5, 0.1, 0.2) for m in range(70) for k in range(12)]
    table = spark.createDataFrame(rows, "method string, " + METHOD)
    assert comparison.matched_comparison(table).count() == 840
    holed = table.filter("NOT (method = 'm64' AND replicate >= 4)").unionByName(
        spark.createDataFrame([("m64", "a", 7, 0.5, 0.5, 0.1, 0.2)], "method string, " + METHOD)
    )
    jobs = []
    for some in (holed.filter("method IN ('m00', 'm64')"), holed):
        spark.sparkContext.setJobGroup(f"keys-{len(jobs)}", "keys")
        with pytest.raises(ValueError) as told:
            comparison.matched_comparison(some)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"keys-{len(jobs)}")))
        lacks = [("s", k) for k in range(4, 9)]
        assert f"of m64 are not those of m00: it lacks {lacks} and has [('a', 7)]" in str(told.value)
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]
