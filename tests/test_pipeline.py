import random

import pytest
from pyspark.sql import functions as F

from driftway.operators import resample
from driftway.plans import infer, inspect
from driftway.sources import tables

SIZE = 4
POPULATIONS = {"A": (0.0, 0.0), "B": (1.0, 1.0), "C": (2.0, 2.0)}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    rng = random.Random(5)
    samples = [f"{p}{k}" for p in POPULATIONS for k in range(3)]
    lines = ["##x", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + samples)]
    for pos in range(1, 121):
        gts = ["/".join(rng.choice("0001") for _ in range(2)) for _ in samples]
        lines.append("\t".join(["chr1", str(pos * 50), ".", "A", "G", ".", ".", ".", "GT", *gts]))
    (root / "x.vcf").write_text("\n".join(lines) + "\n")
    (root / "p.tsv").write_text("sample\tpopulation\n" + "".join(f"{s}\t{s[0]}\n" for s in samples))
    (root / "c.csv").write_text("population,latitude,longitude\n" + "".join(f"{p},{a},{b}\n" for p, (a, b) in POPULATIONS.items()))
    return root


def paths(root):
    return [str(root / name) for name in ("x.vcf", "p.tsv", "c.csv")]


def library(spark):
    """Two models whose asymmetric one fits better; rates follow the entry number."""
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIZE).cast("long")))
    entries = spark.createDataFrame(
        [(m, k) for m in ("asymmetric_migration", "isolation") for k in range(1, 5)], "model string, param_id int"
    )
    cells = entries.select("*", step.alias("i")).select("*", step.alias("j"))
    flat = F.when(F.col("model") == "isolation", F.exp(3.0 * (F.col("i") + F.col("j")))).otherwise(
        F.exp(-(F.col("i") + F.col("j")) * (1.0 + F.col("param_id") / 100))
    )
    params = F.create_map(F.lit("m_a_to_b"), F.col("param_id") * 1.0, F.lit("m_b_to_a"), F.lit(0.1))
    return cells.select("model", "param_id", "i", "j", flat.alias("expected")), entries.select("model", "param_id", params.alias("params"))


def test_prepare_only(spark, files, tmp_path):
    options = infer.InferOptions(projection_chromosomes=SIZE, k_nearest=1, prepare_only=True)
    result = infer.run_pipeline(spark, *paths(files), str(tmp_path / "out"), options)
    rows = result.pairwise.collect()
    assert {(r["population_a"], r["population_b"]) for r in rows} == {("A", "B"), ("B", "C")}
    assert {r["status"] for r in rows} == {"prepared"} and all(r["loci_used"] == 120 for r in rows)
    saved = tables.read_spectra(spark, str(tmp_path / "out" / "spectra"), "A", "B")
    assert saved.agg(F.sum("mass")).first()[0] == pytest.approx(120.0)
    assert not (tmp_path / "out" / "directional_flows").exists()
    meta = spark.read.parquet(str(tmp_path / "out" / "run_metadata")).first()
    assert meta["bootstrap_resampling_unit"] == "locus" and meta["spectrum_orientation"] == "unpolarized/folded"
    assert spark.read.parquet(str(tmp_path / "out" / "input_records")).count() == 3


@pytest.mark.parametrize("block", [None, 500])
def test_full_run(spark, files, tmp_path, block):
    cells, parameters = library(spark)
    options = infer.InferOptions(
        projection_chromosomes=SIZE, max_distance_km=200.0, bootstrap_replicates=4, bootstrap_block_bp=block,
        min_abs_asymmetry=0.2, min_directional_support=0.9, min_model_weight=0.5,
    )
    out = tmp_path / "out"
    result = infer.run_pipeline(spark, *paths(files), str(out), options, library=cells, parameters=parameters)
    rows = result.pairwise.collect()
    assert len(rows) == 2
    for row in rows:
        assert row["best_model"] == "asymmetric_migration" and row["bootstrap_successful"] == 4
        assert row["status"] in ("supported", "ambiguous") and row["bootstrap_loci_used"] == 120
        assert row["bootstrap_blocks_used"] == (120 if block is None else 12)
        assert row["preferred_direction"] == f"{row['population_a']}->{row['population_b']}"
    assert spark.read.parquet(str(out / "model_rankings")).count() == 4
    flows = spark.read.parquet(str(out / "directional_flows"))
    assert flows.count() == 2 and spark.read.parquet(str(out / "map_edges")).count() == 2
    assert set(tables.read_result_tables(spark, str(out))) == set(tables.RESULT_TABLES)


def test_statuses_without_bootstrap(spark):
    schema = "chrom string, pos long, ref string, alt string, population string, alt_count long, called_chromosomes long"
    rows = [("1", p, "A", "G", pop, (p + k) % 5, 4) for p in range(30) for k, pop in enumerate("AB")]
    rows += [("1", 99, "A", "G", "C", 1, 2)]
    pairs = spark.createDataFrame([("A", "B", 1.0), ("A", "C", 2.0)], "population_a string, population_b string, distance_km double")
    run = "population_a string, population_b string, model string, run int, success boolean, log_likelihood double, params map<string,double>"
    rates = {"m_a_to_b": 1.0, "m_b_to_a": 0.1}

    def runs(best):
        score = {"asymmetric_migration": -50.0, "isolation": -50.0, best: -10.0}
        return spark.createDataFrame([("A", "B", m, k, True, s - k / 10, rates) for m, s in score.items() for k in range(3)], run)

    counts = spark.createDataFrame(rows, schema)
    options = infer.InferOptions(projection_chromosomes=4)
    got = {}
    for best in ("asymmetric_migration", "isolation"):
        result = infer.infer_pairs(counts, pairs, options, fit_runs=runs(best))
        got[best] = {r["population_b"]: r for r in result.pairwise.collect()}
    assert got["asymmetric_migration"]["B"]["status"] == "candidate"
    assert got["isolation"]["B"]["status"] == "unsupported"
    assert got["isolation"]["B"]["decision_reason"] == infer.NOT_DIRECTIONAL
    assert got["isolation"]["C"]["status"] == "no_usable_loci"
    with_estimator = infer.InferOptions(projection_chromosomes=4, bootstrap_replicates=3)
    row = infer.infer_pairs(
        counts, pairs, with_estimator, fit_runs=runs("asymmetric_migration"), estimator=resample.linear_moment_estimator
    ).pairwise.filter("population_b = 'B'").first()
    assert row["status"] == "supported" and row["bootstrap_attempted"] == 3


def test_every_pair_has_a_status(spark):
    """Monomorphic pairs, pairs without fits and pairs without bootstrap estimates stay, and say why."""
    schema = "chrom string, pos long, ref string, alt string, population string, alt_count long, called_chromosomes long"
    rows = [("01", p, "A", "G", pop, (p + k) % 5, 4) for p in range(30) for k, pop in enumerate(("001", "B", "F"))]
    rows += [("01", p, "A", "G", "M", 0, 4) for p in range(100, 106)] + [("01", p, "A", "G", "N", 0, 4) for p in range(100, 106)]
    names = [("001", "B"), ("001", "F"), ("M", "N"), ("001", "M"), ("B", "F")]
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in names], "population_a string, population_b string, distance_km double")
    run = "population_a string, population_b string, model string, run int, success boolean, log_likelihood double, params map<string,double>"
    rates = {"m_a_to_b": 1.0, "m_b_to_a": 0.1}
    fits = spark.createDataFrame(
        [(a, b, m, k, True, s - k / 10, rates) for a, b in (("001", "B"), ("B", "F"))
         for m, s in (("asymmetric_migration", -10.0), ("isolation", -50.0)) for k in range(3)], run,
    )

    def estimator(cells, keys):
        return resample.linear_moment_estimator(cells.filter("population_a = '001'"), keys)

    options = infer.InferOptions(projection_chromosomes=4, bootstrap_replicates=3)
    result = infer.infer_pairs(spark.createDataFrame(rows, schema), pairs, options, fit_runs=fits, estimator=estimator)
    got = {(r["population_a"], r["population_b"]): r for r in result.pairwise.collect()}
    assert set(got) == set(names) and all(r["status"] is not None for r in got.values())
    assert got["001", "B"]["status"] in ("supported", "ambiguous") and got["001", "B"]["bootstrap_successful"] == 3
    assert (got["001", "F"]["status"], got["001", "F"]["decision_reason"]) == (infer.NOT_FITTED, infer.NOT_FITTED_REASON)
    assert (got["M", "N"]["status"], got["M", "N"]["loci_used"]) == (infer.UNINFORMATIVE, 6)
    assert got["001", "M"]["status"] == infer.NO_LOCI
    lost = got["B", "F"]
    assert (lost["status"], lost["decision_reason"]) == ("unsupported", infer.FEW_ESTIMATES)
    assert lost["best_model"] == "asymmetric_migration" and lost["m_a_to_b_scaled"] == 1.0
    assert (lost["bootstrap_successful"], lost["bootstrap_attempted"]) == (0, 3)


def test_identifiers_stay_text_and_runs_repeat(spark, tmp_path):
    samples = [f"{p}{k}" for p in ("001", "1") for k in "ab"]
    lines = ["\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + samples)]
    for chrom in ("01", "1"):
        for pos in range(1, 41):
            gts = [f"{(pos + k) % 2}/{(pos + 2 * k) % 3 % 2}" for k in range(4)]
            lines.append("\t".join([chrom, str(pos), ".", "A", "G", ".", ".", ".", "GT", *gts]))
    (tmp_path / "x.vcf").write_text("\n".join(lines) + "\n")
    (tmp_path / "p.tsv").write_text("sample\tpopulation\n" + "".join(f"{s}\t{s[:-1]}\n" for s in samples))
    (tmp_path / "c.csv").write_text("population,latitude,longitude\n001,0.0,0.0\n1,1.0,1.0\n")
    options = infer.InferOptions(projection_chromosomes=SIZE, k_nearest=1, prepare_only=True)
    out = tmp_path / "out"
    seen = []
    for _ in range(2):
        result = infer.run_pipeline(spark, *paths(tmp_path), str(out), options)
        row = result.pairwise.first()
        assert (row["population_a"], row["population_b"], row["loci_used"]) == ("001", "1", 80)
        assert result.spectra.schema["population_a"].dataType.simpleString() == "string"
        seen.append(sorted(result.spectra.collect()))
    assert seen[0] == seen[1] and len(seen[0]) > 0
    counts = spark.read.parquet(str(out / "allele_counts"))
    assert {r["chrom"] for r in counts.select("chrom").distinct().collect()} == {"01", "1"}
    assert not [p for p in out.iterdir() if p.name.startswith("work")]


@pytest.mark.parametrize(
    "changes", [{"projection_chromosomes": 1}, {"bootstrap_replicates": 1}, {"bootstrap_block_bp": 0}, {"min_model_weight": 2.0}]
)
def test_options_are_checked(changes):
    with pytest.raises(ValueError):
        infer.InferOptions(**{"projection_chromosomes": 4, **changes}).checked()


def test_thresholds_file_sets_options(spark):
    table = spark.createDataFrame([(0.6, 0.9, 0.3)], "min_model_weight double, min_directional_support double, min_abs_asymmetry double")
    options = infer.with_thresholds(infer.InferOptions(projection_chromosomes=4), table)
    assert (options.min_model_weight, options.min_directional_support, options.min_abs_asymmetry) == (0.6, 0.9, 0.3)


def test_inspect(spark, files, tmp_path):
    found = inspect.inspect_dataset(spark, *paths(files), output_folder=str(tmp_path / "out"))
    totals = found.totals.first()
    assert (totals["samples"], totals["populations"], totals["loci"]) == (9, 3, 120)
    assert found.recommended_projection.first()[0] == 6 and found.recommended_neighbors == 2
    assert found.graph_summary.count() == 1
    assert spark.read.parquet(str(tmp_path / "out" / "projection_recommendations")).count() == 3
