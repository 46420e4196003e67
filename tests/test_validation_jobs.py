"""The file-to-file validation jobs, from written tables to a release review."""

import json

from driftway.operators import comparison
from driftway.plans import validate
from driftway.sources import tables
from tests.test_validation import EVIDENCE, EVIDENCE_ROWS, campaign

METHOD = "scenario string, replicate int, {0}_m_a_to_b double, {0}_m_b_to_a double, estimated_m_a_to_b double, estimated_m_b_to_a double"


def test_campaign_from_files_to_review(spark, tmp_path):
    root = campaign(spark, tmp_path / "campaign", skip=("thresholds", "methods", "metadata", "requirements"))
    spark.createDataFrame(EVIDENCE_ROWS, EVIDENCE).write.option("header", True).csv(str(tmp_path / "evidence"))
    made = validate.calibrate(spark, str(tmp_path / "evidence"), f"{root}/threshold_calibration", max_false_direction=0.0)
    assert made.scan.count() == 100
    chosen = made.selected.first()
    for name in ("selected_thresholds.csv", "selected_thresholds.json"):
        again = tables.load_thresholds(spark, f"{root}/threshold_calibration/{name}").first()
        assert again["min_model_weight"] == chosen["min_model_weight"] == 0.9

    found = validate.data_requirements(spark, f"{root}/recovery_grid/recovery_grid_summary.csv", f"{root}/data_requirements")
    assert found.recommendation.first()["status"] == "recommendations_available" and found.minima.count() == 1

    truth = [("s", k, 1.0, 0.5) for k in range(4)]
    spark.createDataFrame([(*t, 1.1, 0.4) for t in truth], METHOD.format("true")).write.parquet(str(tmp_path / "own.parquet"))
    spark.createDataFrame([(*t, 0.9, 0.6, "scaled_migration", "2.1") for t in truth], METHOD.format("truth") + ", estimand string, method_version string").write.option("header", True).csv(str(tmp_path / "other"))
    compared = validate.compare_methods(
        spark, {"driftway": str(tmp_path / "own.parquet"), "other": str(tmp_path / "other")}, f"{root}/external_comparison", benchmark=("driftway",),
    )
    assert compared.results.count() == 8 and {r["direction_accuracy"] for r in compared.summary.collect()} == {1.0}
    assert comparison.matched_comparison(compared.results).count() == 8

    for _ in range(2):  # a second run replaces the first
        made = validate.review(spark, root, f"{root}/release")
    rows = {(r["section"], r["metric"]): r for r in made.checks.collect()}
    assert len(rows) == 15 and rows["external_comparison", "external_method_versions"]["passed"]
    blocked = made.overall.first()
    assert not blocked["release_ready"] and {b["section"] for b in blocked["blockers"]} == {"threshold_calibration"}
    written = spark.read.csv(f"{root}/release/release_checks.csv", header=True)
    assert written.count() == 15
    (part,) = (tmp_path / "campaign" / "release" / "release_review.json").glob("part-*")
    assert json.loads(part.read_text())["checks_total"] == 15
