"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftway.functions import rates, special
from driftway.operators import (
    comparison,
    counts as counting,
    decisions,
    gates,
    geography,
    inspection,
    metrics,
    models,
    network,
    regimes,
    resample,
    search,
    spectra,
    summaries,
    thresholds,
    transition,
)
from driftway.operators.spectra import PAIR
from driftway.plans import infer
from driftway.plans.fixtures import frame
from driftway.session import materialize, parts_of, work_folder
from driftway.sources import block_gzip, inventory, tables, vcf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SIZE = 8
BLOCK_BP = 250_000
REPLICATES = 20
SEED = 42
NE = 500
MODEL_KEYS = ["pair_id", "model"]
# Lines of a written VCF file. A compressed file is one task, for its writer and for its reader.
_LINES_PER_FILE = 5_000
# Library entries of a task; each becomes a row per cell.
_ENTRIES_PER_TASK = 20_000


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    names = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({n: F.round(n, digits) for n in names}) if names else df


# Sources and counts.


def vcf_text(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(lines, header) of the VCF text that the genotype view describes.

    One column per sample of the map; the few sample names are the header line.
    """
    genotypes = frame(spark, sf, "genotypes")
    samples = [r[0] for r in frame(spark, sf, "popmap").select("sample").orderBy("sample").collect()]
    fixed = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])
    header = spark.createDataFrame([("mem.vcf", "\t".join([fixed, *samples]), False)], vcf.HEADERS_SCHEMA)
    depth = F.concat_ws(":", F.length("sample").cast("string"), "gt")
    called = F.when(F.col("gt") == "./.", F.col("gt")).otherwise(depth)
    # At most one entry per sample of the header.
    entries = F.map_from_entries(F.collect_list(F.struct("sample", called.alias("field"))))
    fields = genotypes.groupBy("chrom", "pos").agg(entries.alias("fields"))
    names = F.array(*[F.lit(s) for s in samples])
    columns = F.transform(names, lambda s: F.coalesce(F.try_element_at("fields", s), F.lit("./.")))
    lead = [F.col("chrom"), F.col("pos").cast("string"), *[F.lit(x) for x in (".", "A", "G", ".", "PASS", ".", "DP:GT")]]
    lines = fields.select(
        F.concat_ws("\t", *lead, columns).alias("value"),
        F.lit("mem.vcf").alias("file_path"),
        F.col("pos").alias("line_in_file"),
    )
    return lines, header


@query
def vcf_allele_counts(spark, sf):
    lines, header = vcf_text(spark, sf)
    counted = vcf.allele_counts_from_lines(lines, header, frame(spark, sf, "popmap"))
    return counted.drop("line_no")


def vcf_files(spark: SparkSession, sf: str) -> list[str]:
    """Folders of VCF files with that text: plain ones, then gzip-compressed ones that repeat every fifth locus otherwise."""
    lines, header = vcf_text(spark, sf)
    head = ["##source=genotype view", header.first()["header"]]
    folder = work_folder(spark, "vcf-files")

    def headed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": head})
        yield from batches

    text = materialize(lines.select("value", "line_in_file"))
    first = F.col("line_in_file") % 2 == 0
    repeated = text.filter(first & (F.col("line_in_file") % 5 == 0)).withColumn("value", F.regexp_replace("value", "0/0", "1/1"))
    parts = {"a": text.filter(first), "b": text.filter(~first).unionByName(repeated)}
    for name, part in parts.items():
        count = max(3, parts_of(part.count(), _LINES_PER_FILE))
        files = part.select("value").repartition(count).mapInArrow(headed, "value string")
        files.write.option("compression", "none" if name == "a" else "gzip").text(f"{folder}/{name}")
    return [f"{folder}/{name}" for name in parts]


@query
def vcf_file_counts(spark, sf):
    """Counts of text files, plain and compressed; a locus that comes again keeps its first counts."""
    counted = vcf.allele_counts_from_vcf(spark, vcf_files(spark, sf), frame(spark, sf, "popmap"))
    return spectra.first_counts(counted).select("chrom", "pos", "ref", "alt", "population", "alt_count", "called_chromosomes")


@query
def vcf_block_gzip_counts(spark, sf):
    """Counts of block-compressed files, each read in many ranges; a locus that comes again keeps its first counts."""
    lines, header = vcf_text(spark, sf)
    head = ["##source=genotype view", header.first()["header"]]
    text = materialize(lines.select("value", "line_in_file"))
    changed = F.regexp_replace("value", "0/0", "1/1")
    folder = work_folder(spark, "vcf-blocks")
    # a repeated locus stands behind all others of its file
    text = text.select("value", F.col("line_in_file").alias("locus"), F.lit(0).alias("turn"))
    again = text.filter(F.col("locus") % 7 == 0).select(changed.alias("value"), "locus", F.lit(1).alias("turn"))
    count = max(3, parts_of(text.count(), _LINES_PER_FILE))
    both = text.unionByName(again).repartition(count, "locus").sortWithinPartitions("turn", "locus")
    files = block_gzip.write_block_gzip(both, folder, head, block_text=8192)
    read = vcf.read_vcf_lines(spark, files, range_bytes=16_384)
    counted = vcf.allele_counts_from_lines(read, vcf.read_headers(spark, files), frame(spark, sf, "popmap"))
    return spectra.first_counts(counted).select("chrom", "pos", "ref", "alt", "population", "alt_count", "called_chromosomes")


# Files written from the derived tables and read back through the readers and their rules.


@query
def popmap_file(spark, sf):
    path = work_folder(spark, "popmap")
    frame(spark, sf, "people").write.csv(path, sep="\t", header=True)
    return tables.read_popmap(spark, path)


@query
def coordinates_file(spark, sf):
    path = work_folder(spark, "coordinates")
    frame(spark, sf, "places").write.csv(path, header=True)
    return rounded(tables.validate_coordinates(tables.read_coordinates(spark, path)), 9)


@query
def replicates_file(spark, sf):
    path = work_folder(spark, "replicates")
    table = frame(spark, sf, "replicates")
    table.write.csv(path, header=True)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return rounded(comparison.summarize_methods(tables.read_replicates(spark, path, kinds)), 8)


@query
def thresholds_file(spark, sf):
    path = work_folder(spark, "thresholds") + ".json"
    chosen = select_thresholds(spark, sf)
    chosen.select(F.struct(*chosen.columns).alias("selected_thresholds")).coalesce(1).write.json(path)  # one row
    return rounded(tables.load_thresholds(spark, path))


@query
def allele_counts(spark, sf):
    return counting.count_calls(frame(spark, sf, "calls"))


@query
def allele_counts_min_called(spark, sf):
    return counting.count_calls(frame(spark, sf, "calls"), min_called_chromosomes=10)


@query
def locus_totals(spark, sf):
    return inspection.dataset_totals(frame(spark, sf, "counts"), frame(spark, sf, "people"))


@query
def file_inventory(spark, sf):
    return inventory.file_inventory(spark, sf)


# Spectra.


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of regions."""
    return inspection.population_pairs(frame(spark, sf, "region").select(F.col("r_name").alias("population")))


def _firsts(spark: SparkSession, sf: str) -> DataFrame:
    # Counted from calls, a locus and population have one row already.
    return counting.count_calls(frame(spark, sf, "calls"))


def _shared(spark: SparkSession, sf: str) -> DataFrame:
    return spectra.shared_loci(_firsts(spark, sf), _pairs(spark, sf))


def _configs(spark: SparkSession, sf: str) -> DataFrame:
    return spectra.configurations(_shared(spark, sf))


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    return spectra.projected_spectra(_configs(spark, sf), SIZE, SIZE)


def _usable():
    return (F.col("n_a") >= SIZE) & (F.col("n_b") >= SIZE)


@query
def pair_configurations(spark, sf):
    return _configs(spark, sf)


@query
def jsfs_exact(spark, sf):
    return spectra.exact_spectra(_configs(spark, sf))


@query
def jsfs_exact_stats(spark, sf):
    firsts, pairs = _firsts(spark, sf), _pairs(spark, sf)
    configs = spectra.configurations(spectra.shared_loci(firsts, pairs))
    sized = configs.join(spectra.modal_sizes(configs), PAIR)
    usable = (F.col("n_a") == F.col("chromosomes_a")) & (F.col("n_b") == F.col("chromosomes_b"))
    return spectra.spectrum_stats(sized, spectra.candidate_loci(firsts, pairs, configs), usable)


@query
def jsfs_mode_size(spark, sf):
    return spectra.modal_sizes(_configs(spark, sf))


@query
def jsfs_projected(spark, sf):
    return rounded(_projected(spark, sf))


@query
def jsfs_projected_stats(spark, sf):
    firsts, pairs = _firsts(spark, sf), _pairs(spark, sf)
    configs = spectra.configurations(spectra.shared_loci(firsts, pairs))
    return spectra.spectrum_stats(configs, spectra.candidate_loci(firsts, pairs, configs), _usable())


@query
def jsfs_folded(spark, sf):
    return rounded(spectra.fold_spectra(_projected(spark, sf), SIZE, SIZE))


@query
def jsfs_polarized(spark, sf):
    return rounded(spectra.fold_spectra(_projected(spark, sf), SIZE, SIZE, polarized=True))


@query
def spectrum_observations(spark, sf):
    return spectra.nonzero_cells(spectra.exact_spectra(_configs(spark, sf)))


@query
def hypergeom_table(spark, sf):
    seen = counting.count_calls(frame(spark, sf, "calls")).select(
        F.col("called_chromosomes").alias("called"), F.col("alt_count").alias("alt")
    )
    return rounded(special.hypergeom_table(seen, SIZE), 9)


# Geography and inspection.


@query
def candidate_pairs_distance(spark, sf):
    return rounded(geography.candidate_pairs(frame(spark, sf, "places"), max_distance_km=1500.0))


@query
def candidate_pairs_knn(spark, sf):
    return rounded(geography.candidate_pairs(frame(spark, sf, "places"), k_nearest=3))


@query
def candidate_pairs_both(spark, sf):
    return rounded(geography.candidate_pairs(frame(spark, sf, "places"), max_distance_km=900.0, k_nearest=2))


@query
def candidate_pairs_all(spark, sf):
    return rounded(geography.candidate_pairs(frame(spark, sf, "nation_places")))


@query
def graph_options(spark, sf):
    return rounded(geography.graph_options(frame(spark, sf, "places")))


def _retention(spark: SparkSession, sf: str) -> DataFrame:
    firsts, pairs = materialize(_firsts(spark, sf)), _pairs(spark, sf)
    configs = spectra.configurations(spectra.shared_loci(firsts, pairs))
    return inspection.projection_retention(firsts, configs, pairs)


@query
def projection_retention(spark, sf):
    return rounded(_retention(spark, sf))


@query
def recommend_projection(spark, sf):
    return inspection.recommend_projection(_retention(spark, sf), retention_target=0.5)


# Resampling.


def _block_cells(spark: SparkSession, sf: str) -> DataFrame:
    return resample.block_spectra(_shared(spark, sf), BLOCK_BP, SIZE, SIZE)


@query
def block_spectra(spark, sf):
    return rounded(_block_cells(spark, sf))


@query
def block_ordinals(spark, sf):
    return resample.block_ordinals(resample.block_configurations(_shared(spark, sf), BLOCK_BP))


@query
def bootstrap_weights(spark, sf):
    ordinals = resample.block_ordinals(resample.block_configurations(_shared(spark, sf), BLOCK_BP).filter(_usable()))
    sizes = ordinals.groupBy(*PAIR).agg(F.count("*").alias("n"))
    return resample.draw_counts(sizes, REPLICATES, SEED)


def _replicate_cells(spark: SparkSession, sf: str) -> DataFrame:
    blocks = materialize(resample.block_configurations(_shared(spark, sf), BLOCK_BP))
    return resample.resample_block_configurations(blocks, REPLICATES, SEED, SIZE, SIZE)


@query
def bootstrap_spectra(spark, sf):
    return rounded(_replicate_cells(spark, sf))


@query
def bootstrap_summary(spark, sf):
    estimates = resample.linear_moment_estimator(_replicate_cells(spark, sf), [*PAIR, "replicate"])
    return rounded(resample.bootstrap_summary(estimates, PAIR, attempted=REPLICATES), 8)


def _poisson_cells(spark: SparkSession, sf: str) -> DataFrame:
    blocks = resample.block_configurations(_shared(spark, sf), BLOCK_BP)
    return resample.poisson_block_configurations(blocks, REPLICATES, SEED, SIZE, SIZE)


@query
def poisson_bootstrap_spectra(spark, sf):
    return rounded(_poisson_cells(spark, sf))


@query
def poisson_bootstrap_summary(spark, sf):
    estimates = resample.linear_moment_estimator(_poisson_cells(spark, sf), [*PAIR, "replicate"])
    return rounded(resample.bootstrap_summary(estimates, PAIR, attempted=REPLICATES), 8)


@query
def locus_bootstrap_mass(spark, sf):
    """Every replicate of a locus bootstrap draws as many loci as are usable."""
    drawn = resample.resample_loci(_configs(spark, sf), REPLICATES, SEED, SIZE, SIZE)
    return rounded(drawn.groupBy(*PAIR, "replicate").agg(F.sum("mass").alias("mass")), 5)


@query
def locus_bootstrap_summary(spark, sf):
    drawn = resample.resample_loci(_configs(spark, sf), REPLICATES, SEED, SIZE, SIZE)
    estimates = resample.linear_moment_estimator(drawn, [*PAIR, "replicate"])
    return rounded(resample.bootstrap_summary(estimates, PAIR, attempted=REPLICATES))


@query
def transition_scan(spark, sf):
    grid = [k / 200 for k in range(1, 41)]
    return rounded(transition.transition_scan(frame(spark, sf, "frequencies"), NE, NE, grid), 3)


@query
def transition_mle(spark, sf):
    found = transition.estimate_one_generation(frame(spark, sf, "frequencies"), NE, NE)
    return found.select(F.round("m_a_to_b", 5).alias("m_a_to_b"), F.round("m_b_to_a", 5).alias("m_b_to_a"))


@query
def transition_bootstrap(spark, sf):
    return rounded(
        transition.bootstrap_one_generation(frame(spark, sf, "frequencies"), NE, NE, replicates=10, seed=SEED), 5
    )


# Models.


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = frame(spark, sf, "fit_runs")
    params = F.create_map(F.lit("m_a_to_b"), F.col("m_a_to_b"), F.lit("m_b_to_a"), F.col("m_b_to_a"))
    return runs.withColumn("params", params)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "fit_runs").filter("success").groupBy(*MODEL_KEYS).agg(
        F.max("log_likelihood").alias("log_likelihood"),
        F.max("parameters").alias("parameters"),
        F.max("observations").alias("observations"),
    )


@query
def aic_ranking(spark, sf):
    return rounded(models.rank_models(_scores(spark, sf), ["pair_id"], use_aicc=False))


@query
def aicc_ranking(spark, sf):
    return rounded(models.rank_models(_scores(spark, sf), ["pair_id"]))


@query
def best_model(spark, sf):
    ranking = models.rank_models(_scores(spark, sf), ["pair_id"], use_aicc=False)
    return rounded(models.best_models(ranking, ["pair_id"]))


@query
def multistart_stability(spark, sf):
    found = models.multistart_summary(_runs(spark, sf), MODEL_KEYS)
    return rounded(found.withColumns({m: F.col("best_params")[m] for m in ("m_a_to_b", "m_b_to_a")}).drop("best_params"))


def _library(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(library cells, parameters): a smooth surface per parameter set, not a demographic model."""
    sets = frame(spark, sf, "library_parameters")
    # the small rows are dealt by entry before they become cells, which then stay where they are
    sets = sets.repartition(parts_of(sets.count(), _ENTRIES_PER_TASK), "model", "param_id")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIZE).cast("long")))
    cells = sets.select("*", steps.alias("i")).select("*", steps.alias("j"))
    surface = F.exp(-F.abs(F.col("i") - F.col("j")) * F.col("m_a_to_b") / 2) / (1 + F.col("i") + F.col("j"))
    tilt = F.when(F.col("model") == "asymmetric_migration", 0.01 * F.col("j") * F.col("m_b_to_a")).otherwise(0.0)
    params = F.create_map(F.lit("m_a_to_b"), F.col("m_a_to_b"), F.lit("m_b_to_a"), F.col("m_b_to_a"))
    return (
        cells.select("model", "param_id", "i", "j", (surface + tilt).alias("expected")),
        sets.select("model", "param_id", params.alias("params")),
    )


def _scan(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    library, parameters = _library(spark, sf)
    return models.library_scan(_projected(spark, sf), library, SIZE, SIZE), parameters


@query
def library_scan(spark, sf):
    """The best entry per pair and model, every entry scored; within 1e-6 of the best one the smaller id is taken."""
    scan, _ = _scan(spark, sf)
    return rounded(search.best_of(materialize(scan), [*PAIR, "model"]).select(*PAIR, "model", "param_id", "log_likelihood", "theta"), 3)


@query
def library_search(spark, sf):
    """The same without scoring every entry."""
    library, _ = _library(spark, sf)
    return rounded(search.best_entries(_projected(spark, sf), library, SIZE, SIZE), 3)


@query
def profile_scan(spark, sf):
    library, parameters = _library(spark, sf)
    found = search.profile_scan(_projected(spark, sf), library, parameters, "m_a_to_b", SIZE, SIZE)
    return rounded(models.profile_deltas(materialize(found)), 3)


@query
def profile_interval(spark, sf):
    scan, parameters = _scan(spark, sf)
    profile = materialize(models.profile_scan(scan, parameters, "m_a_to_b"))
    return rounded(models.profile_interval(profile), 3)


@query
def profile_grid(spark, sf):
    estimates = _scores(spark, sf).select(*MODEL_KEYS, (-F.col("log_likelihood") / 100).alias("mle"))
    return rounded(special.profile_grid(estimates, lower=1e-5, upper=50.0)).distinct()


# Decisions and networks.


@query
def rate_functions(spark, sf):
    forward, reverse = F.col("migration_forward"), F.col("migration_reverse")
    ratio = rates.directional_ratio(forward, reverse)
    return frame(spark, sf, "evidence").select(
        "evidence_id",
        rates.asymmetry_index(forward, reverse).alias("asymmetry"),
        # Infinite ratios are shown as -1.
        F.when(ratio == float("inf"), F.lit(-1.0)).otherwise(ratio).alias("ratio"),
        rates.directional_support(F.col("directional_support"), forward, reverse).alias("support"),
    )


def _decisions(spark: SparkSession, sf: str, **options) -> DataFrame:
    return decisions.classify_direction(frame(spark, sf, "evidence"), keep=["evidence_id"], **options)


@query
def classify_direction(spark, sf):
    return rounded(_decisions(spark, sf), 9)


@query
def classify_direction_intervals(spark, sf):
    return rounded(
        _decisions(spark, sf, min_directional_support=0.6, min_model_weight=0.6, require_interval_separation=True), 9)


def _pair_fits(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "evidence").select(
        "evidence_id",
        F.col("source").alias("population_a"),
        F.col("destination").alias("population_b"),
        F.col("migration_forward").alias("m_a_to_b"),
        F.col("migration_reverse").alias("m_b_to_a"),
        "directional_support", "asymmetric_model_weight", "optimizer_stable",
    )


@query
def provisional_direction(spark, sf):
    return rounded(decisions.provisional_direction(_pair_fits(spark, sf)), 9)


def _flows(spark: SparkSession, sf: str, include_ambiguous: bool = True) -> DataFrame:
    decided = _decisions(spark, sf, min_directional_support=0.6)
    return decisions.decisions_to_flows(decided, include_ambiguous=include_ambiguous, keep=["evidence_id"])


@query
def flow_table(spark, sf):
    return rounded(_flows(spark, sf, include_ambiguous=False), 9)


@query
def flow_table_ambiguous(spark, sf):
    return rounded(_flows(spark, sf), 9)


def _pairwise(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions in the shape of a pairwise result table."""
    decided = _decisions(spark, sf, min_directional_support=0.6)
    return decided.withColumnsRenamed(
        {
            "source": "population_a", "destination": "population_b",
            "migration": "m_a_to_b_scaled", "reverse_migration": "m_b_to_a_scaled",
        }
    )


@query
def pairwise_flows(spark, sf):
    return rounded(decisions.pairwise_to_flows(_pairwise(spark, sf), keep=["evidence_id"]), 9)


@query
def status_counts(spark, sf):
    return decisions.status_counts(_pairwise(spark, sf))


@query
def map_edges(spark, sf):
    edges = network.map_edges(
        frame(spark, sf, "nation_places"), _flows(spark, sf), min_migration=0.5, min_support=0.3,
        include_ambiguous=True, keep=["evidence_id"],
    )
    return rounded(edges, 9)


@query
def network_edges(spark, sf):
    return rounded(network.network_edges(_flows(spark, sf), include_ambiguous=True, order="evidence_id"), 9)


@query
def source_sink(spark, sf):
    edges = network.network_edges(_flows(spark, sf), order="evidence_id")
    return rounded(network.source_sink_summary(edges), 9)


# Metrics and summaries.


@query
def metrics_bias_rmse(spark, sf):
    keys = ["method", "scenario"]
    table = frame(spark, sf, "replicates")
    return rounded(metrics.parameter_errors(table, keys, "truth_m_a_to_b", "estimated_m_a_to_b"), 8)


@query
def interval_coverage(spark, sf):
    table = frame(spark, sf, "replicates")
    keys = ["method", "scenario"]
    return rounded(metrics.interval_coverage(table, keys, "truth_m_a_to_b", "m_a_to_b_lower", "m_a_to_b_upper"))


@query
def direction_accuracy(spark, sf):
    return rounded(metrics.direction_accuracy(frame(spark, sf, "replicates"), ["method", "scenario"]))


@query
def direction_accuracy_tolerance(spark, sf):
    return rounded(metrics.direction_accuracy(frame(spark, sf, "replicates"), ["method", "scenario"], tolerance=0.3))


@query
def false_direction_rate(spark, sf):
    symmetric = frame(spark, sf, "replicates").filter("expected_direction = 'symmetric'")
    return rounded(metrics.false_direction_rate(symmetric, ["method"]))


def _recovery(spark: SparkSession, sf: str) -> DataFrame:
    named = frame(spark, sf, "replicates").withColumnsRenamed(
        {"truth_m_a_to_b": "true_m_a_to_b", "truth_m_b_to_a": "true_m_b_to_a"}
    )
    return named


@query
def recovery_summary(spark, sf):
    return rounded(summaries.summarize_recovery(_recovery(spark, sf), by=["method"]), 8)


def _stress(spark: SparkSession, sf: str) -> DataFrame:
    signals = summaries.provisional_signal(frame(spark, sf, "stress_replicates"))
    return signals.withColumn("correct_model_selected", F.col("best_model") == F.col("generating_model"))


@query
def provisional_signal(spark, sf):
    return rounded(_stress(spark, sf))


@query
def stress_summary(spark, sf):
    return rounded(summaries.summarize_stress(_stress(spark, sf)))


@query
def stress_summary_grid(spark, sf):
    return rounded(summaries.summarize_stress(_stress(spark, sf), by=["grid_cell"]))


@query
def forward_summary(spark, sf):
    return rounded(summaries.summarize_forward_stress(_stress(spark, sf)))


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.coverage_rows(frame(spark, sf, "bootstrap_replicates"), reference_size=F.lit(10000))


@query
def coverage_rows(spark, sf):
    return rounded(_coverage(spark, sf), 9)


@query
def linked_summary(spark, sf):
    return rounded(summaries.summarize_linkage(_coverage(spark, sf)), 9)


def _linkage_grid(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.summarize_linkage(_coverage(spark, sf), by=["recombination_rate"])


@query
def linkage_grid_summary(spark, sf):
    grid = _linkage_grid(spark, sf)
    return rounded(grid.withColumn("recombination_rate", F.round(F.col("recombination_rate") * 1e9, 3)), 9)


@query
def worst_coverage_grid(spark, sf):
    worst = summaries.worst_block_cells(_linkage_grid(spark, sf), ["recombination_rate"])
    return rounded(worst.withColumn("recombination_rate", F.round(F.col("recombination_rate") * 1e9, 3)))


@query
def coverage_pivot(spark, sf):
    summary = summaries.summarize_linkage(_coverage(spark, sf))
    methods = ["locus", "block_50000", "block_100000", "block_250000"]
    return rounded(summaries.coverage_pivot(summary, "coverage_a_to_b", methods))


@query
def recovery_grid_curves(spark, sf):
    return rounded(summaries.recovery_grid_curves(frame(spark, sf, "grid_summary")))


# Thresholds.


@query
def validated_evidence(spark, sf):
    text = frame(spark, sf, "evidence").select(
        "evidence_id", "truth_direction", "preferred_direction",
        *[F.col(c).cast("string").alias(c) for c in ("asymmetric_model_weight", "directional_support", "asymmetry_index")],
        F.when(F.col("optimizer_stable"), F.lit(" Yes")).otherwise(F.lit("0")).alias("optimizer_stable"),
        F.col("interval_separated").cast("string").alias("interval_separated"),
    )
    return rounded(thresholds.validate_evidence(text))


@query
def threshold_scan(spark, sf):
    return rounded(thresholds.scan_thresholds(frame(spark, sf, "evidence")))


@query
def evaluate_thresholds(spark, sf):
    return rounded(thresholds.evaluate_thresholds(frame(spark, sf, "evidence"), 0.6, 0.75, 0.2))


@query
def select_thresholds(spark, sf):
    return rounded(thresholds.select_thresholds(thresholds.scan_thresholds(frame(spark, sf, "evidence"))))


# Regimes.

TARGETS = {"min_direction_accuracy": 0.95, "max_false_direction_rate": 0.045, "min_success_rate": 0.95}


@query
def data_regimes(spark, sf):
    return rounded(regimes.data_regimes(frame(spark, sf, "grid_summary"), **TARGETS))


@query
def pareto_minimum(spark, sf):
    return regimes.pareto_minimum(frame(spark, sf, "regimes"))


def _recommendation(spark: SparkSession, sf: str) -> DataFrame:
    tested = regimes.data_regimes(frame(spark, sf, "grid_summary"), **TARGETS)
    return regimes.recommend_requirements(tested, regimes.pareto_minimum(tested))


@query
def data_requirements(spark, sf):
    shown = F.transform(
        "pareto_minimum_regimes",
        lambda m: F.concat_ws("x", m["chromosomes"].cast("string"), m["segregating_sites"].cast("string")),
    )
    return _recommendation(spark, sf).withColumn("pareto_minimum_regimes", F.array_join(shown, ","))


# Method comparison.


def _method_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    table = frame(spark, sf, "replicates")
    return {
        name: comparison.standardize_benchmark(
            table.filter(F.col("method") == name), estimand="scaled", version=version
        )
        for name, version in (("engine", "1"), ("other", "2"))
    }


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.matched_comparison(comparison.combine_methods(_method_tables(spark, sf)))


@query
def matched_comparison(spark, sf):
    return rounded(_matched(spark, sf))


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "replicates")


@query
def method_summary(spark, sf):
    return rounded(comparison.summarize_methods(_combined(spark, sf)), 8)


@query
def direction_only_summary(spark, sf):
    return rounded(comparison.summarize_methods(_combined(spark, sf), direction_only=True))


@query
def method_pivot(spark, sf):
    return rounded(comparison.method_pivot(comparison.summarize_methods(_combined(spark, sf)), methods=["engine", "other"]))


@query
def method_pivot_false(spark, sf):
    summary = comparison.summarize_methods(_combined(spark, sf))
    return rounded(comparison.method_pivot(summary, "false_directional_positive_rate", ["engine", "other"]))


@query
def comparison_metadata(spark, sf):
    tables = _method_tables(spark, sf)
    joined = tables["engine"].withColumn("method", F.lit("engine")).unionByName(
        tables["other"].withColumn("method", F.lit("other"))
    )
    found = comparison.comparison_metadata(joined)
    return found.select(
        "direction_only", "require_complete_match", "asymmetry_threshold", "magnitude_metrics_reported",
        F.array_join("methods", ",").alias("methods"),
        F.array_join("estimands", ",").alias("estimands"),
        F.array_join(F.flatten(F.map_values("method_versions")), ",").alias("versions"),
    )


# Gates.


def _studies(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables that a release review reads, by section."""
    labelled = [t.withColumn("method", F.lit(name)) for name, t in _method_tables(spark, sf).items()]
    return {
        "recovery_grid": frame(spark, sf, "grid_summary"),
        "threshold_calibration": thresholds.evaluate_thresholds(frame(spark, sf, "evidence"), 0.6, 0.75, 0.2),
        "mechanistic_linkage": summaries.summarize_linkage(_coverage(spark, sf)),
        "external_comparison": comparison.summarize_methods(_combined(spark, sf)),
        "comparison_record": comparison.comparison_metadata(labelled[0].unionByName(labelled[1])),
        "data_requirements": _recommendation(spark, sf),
    }


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    criteria, found = gates.Criteria().checked(), _studies(spark, sf)
    record = found["comparison_record"].first().asDict(recursive=True)  # one row
    parts = (
        gates.review_recovery_grid(found["recovery_grid"], criteria),
        gates.review_thresholds(found["threshold_calibration"], criteria),
        gates.review_linkage(found["mechanistic_linkage"], criteria),
        gates.review_comparison(found["external_comparison"], record, own_method="engine"),
        gates.review_requirements(found["data_requirements"]),
    )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def _overall(checks: DataFrame) -> DataFrame:
    told = F.transform("blockers", lambda b: F.concat(b["section"], F.lit("/"), b["metric"], F.lit(": "), b["detail"]))
    return gates.overall(checks).withColumn("blockers", F.array_join(told, "; "))


@query
def release_gates(spark, sf):
    return rounded(_gates(spark, sf))


@query
def release_overall(spark, sf):
    return _overall(_gates(spark, sf))


def _campaign(spark: SparkSession, sf: str) -> str:
    """A campaign folder with the files of all studies but the one on linkage."""
    folder, found = work_folder(spark, "campaign"), _studies(spark, sf)
    for section, name in (
        ("recovery_grid", "recovery_grid_summary"), ("threshold_calibration", "selected_thresholds"),
        ("external_comparison", "method_comparison_summary"),
    ):
        found[section].write.csv(f"{folder}/{section}/{name}.csv", header=True)
    for section, name, table in (
        ("external_comparison", "comparison_metadata", "comparison_record"), ("data_requirements", "data_requirements", "data_requirements"),
    ):
        found[table].coalesce(1).write.json(f"{folder}/{section}/{name}.json")  # one row
    return folder


@query
def campaign_gates(spark, sf):
    """Gates of a campaign read from its files; a study that left none is a failed check."""
    folder = _campaign(spark, sf)
    checks, _ = gates.review_campaign(spark, folder, own_method="engine")
    return rounded(checks.withColumn("detail", F.replace("detail", F.lit(folder), F.lit("campaign"))))


@query
def campaign_overall(spark, sf):
    folder = _campaign(spark, sf)
    checks, _ = gates.review_campaign(spark, folder, own_method="engine")
    return _overall(checks.withColumn("detail", F.replace("detail", F.lit(folder), F.lit("campaign"))))


# End to end.


@query
def infer_pairs(spark, sf):
    """Counts, spectra, library fits, block bootstrap and decisions for every pair of regions."""
    counts = counting.count_calls(frame(spark, sf, "calls"))
    pairs = _pairs(spark, sf).withColumn("distance_km", F.lit(0.0))
    library, parameters = _library(spark, sf)
    options = infer.InferOptions(
        projection_chromosomes=SIZE, bootstrap_replicates=4, bootstrap_block_bp=BLOCK_BP, seed=SEED,
        min_model_weight=0.5,
    )
    result = infer.infer_pairs(counts, pairs, options, library=library, parameters=parameters)
    return rounded(result.pairwise)


