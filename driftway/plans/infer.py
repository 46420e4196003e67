"""From variant calls to a directed network, all population pairs at once."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftway.functions.checks import is_finite, require_unit_interval
from driftway.functions.rates import directional_support
from driftway.operators import decisions, geography, models, network, resample, spectra
from driftway.operators.resample import Estimator
from driftway.operators.spectra import PAIR
from driftway.session import materialize, remove_folder
from driftway.sources import inventory, sinks, tables, vcf

# Statuses and reasons of pairs that the evidence does not reach.
NO_LOCI = "no_usable_loci"
UNINFORMATIVE = "no_informative_loci"
NOT_FITTED = "not_fitted"
UNINFORMATIVE_REASON = "every usable locus is fixed alike in both populations"
NOT_FITTED_REASON = "no model was fitted for this pair"
FEW_ESTIMATES = "fewer than two bootstrap estimates are available for this pair"
# Fixed value: reason given when the best model is not directional.
NOT_DIRECTIONAL = "best-supported demographic model is not asymmetric"
STATUS_NOTE = (
    "supported/ambiguous/unsupported uses bootstrap uncertainty only when bootstrap_replicates >= 2; "
    "otherwise candidate labels remain provisional"
)


@dataclass(frozen=True)
class InferOptions:
    """Settings of one inference run."""

    projection_chromosomes: int
    k_nearest: int | None = None
    max_distance_km: float | None = None
    bootstrap_replicates: int = 0
    bootstrap_block_bp: int | None = None
    min_model_weight: float = decisions.MIN_MODEL_WEIGHT
    min_directional_support: float = decisions.MIN_DIRECTIONAL_SUPPORT
    min_abs_asymmetry: float = decisions.MIN_ABS_ASYMMETRY
    min_called_chromosomes: int = 1
    confidence: float = 0.95
    polarized: bool = False
    prepare_only: bool = False
    seed: int = 42

    def checked(self) -> "InferOptions":
        if self.projection_chromosomes < 2:
            raise ValueError("projection_chromosomes is below 2.")
        if self.bootstrap_replicates != 0 and self.bootstrap_replicates < 2:
            raise ValueError("bootstrap_replicates is 0, or 2 and more.")
        if self.bootstrap_block_bp is not None and self.bootstrap_block_bp < 1:
            raise ValueError("bootstrap_block_bp is below 1.")
        require_unit_interval(
            min_model_weight=self.min_model_weight,
            min_directional_support=self.min_directional_support,
            min_abs_asymmetry=self.min_abs_asymmetry,
        )
        return self

    @property
    def orientation(self) -> str:
        return "polarized/unfolded (ALT asserted derived)" if self.polarized else "unpolarized/folded"


def with_thresholds(options: InferOptions, thresholds: DataFrame) -> InferOptions:
    """Options with the three thresholds of a calibrated record."""
    row = thresholds.first()
    names = ("min_model_weight", "min_directional_support", "min_abs_asymmetry")
    return InferOptions(**{**asdict(options), **{name: row[name] for name in names}})


@dataclass
class InferResult:
    pairwise: DataFrame
    rankings: DataFrame | None
    spectra: DataFrame


def _stage(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Cut the plan at a table that several branches read."""
    return materialize(df, f"{folder}/{name}" if folder else None)


def infer_pairs(
    counts: DataFrame,
    pairs: DataFrame,
    options: InferOptions,
    *,
    library: DataFrame | None = None,
    parameters: DataFrame | None = None,
    fit_runs: DataFrame | None = None,
    estimator: Estimator | None = None,
    work_folder: str | None = None,
) -> InferResult:
    """Status, rates and evidence of every candidate pair.

    Models are scored from ``fit_runs`` (population_a, population_b, model, run,
    success, log_likelihood, params) or, without them, by scanning ``library``.
    Bootstrap spectra are fitted by ``estimator`` or by the same library. Pairs
    without usable loci, and pairs whose best model is not directional, take no
    part in the bootstrap. Every pair of ``pairs`` keeps its row and has a status;
    ``decision_reason`` says what is missing where the evidence does not reach it.
    """
    options.checked()
    size = options.projection_chromosomes
    spectra.check_pairs(counts, pairs)
    firsts = _stage(spectra.first_counts(counts), work_folder, "locus_counts")
    shared = spectra.shared_loci(firsts, pairs)
    configs = _stage(spectra.configurations(shared), work_folder, "configurations")
    cells = _stage(spectra.projected_spectra(configs, size, size), work_folder, "projected_cells")

    usable = (F.col("n_a") >= size) & (F.col("n_b") >= size)
    stats = spectra.spectrum_stats(configs, spectra.candidate_loci(firsts, pairs, configs), usable)
    base = pairs.select(*PAIR, "distance_km").join(stats, PAIR).select(
        *PAIR, "distance_km", "loci_used", "loci_skipped",
        F.lit(size).alias("projection_chromosomes"),
        F.lit("spectra").alias("spectrum_file"),
    )
    none = F.col("loci_used") == 0
    if options.prepare_only:
        status = F.when(none, F.lit("no_usable_loci")).otherwise(F.lit("prepared"))
        return InferResult(base.withColumn("status", status), None, cells)
    # tables of a row per pair are written too, so that no plan holds all steps at once
    base = _stage(base, work_folder, "loci_used")

    if fit_runs is None:
        if library is None or parameters is None:
            raise ValueError("give fit_runs, or a library with its parameters.")
        scan = models.library_scan(cells, library, size, size, polarized=options.polarized)
        # the summary reads the runs several times, the library is scanned once
        fit_runs = _stage(models.scan_as_runs(scan, parameters), work_folder, "library_runs")
    fits = _stage(models.multistart_summary(fit_runs, [*PAIR, "model"]), work_folder, "model_fits")
    scores = fits.join(spectra.nonzero_cells(cells), PAIR).select(
        *PAIR, "model", F.col("best_log_likelihood").alias("log_likelihood"),
        F.size("best_params").alias("parameters"), "observations",
    )
    rankings = models.rank_models(scores, use_aicc=False)
    winners = models.best_models(rankings).join(
        fits.select(*PAIR, F.col("model").alias("best_model"), "best_params", "stable", "converged_fraction"),
        [*PAIR, "best_model"],
    )
    winners = _stage(winners, work_folder, "best_models")
    directional = winners.filter(F.col("directional_model").isNotNull()).select(
        *PAIR, "best_model", "directional_model",
        F.col("best_params")["m_a_to_b"].alias("m_a_to_b"),
        F.col("best_params")["m_b_to_a"].alias("m_b_to_a"),
        F.col("best_weight").alias("asymmetric_model_weight"),
        F.col("stable").alias("optimizer_stable"),
        F.col("converged_fraction").alias("optimizer_success_fraction"),
    )
    called = decisions.provisional_direction(
        directional, min_model_weight=options.min_model_weight, min_abs_asymmetry=options.min_abs_asymmetry
    )
    called = called.withColumn("decision_reason", F.lit(None).cast("string"))
    if options.bootstrap_replicates >= 2:
        called = _with_bootstrap(
            _stage(called, work_folder, "directional_pairs"), shared, configs, options, library, parameters, estimator
        )
        called = _stage(called, work_folder, "decisions")
    other = winners.filter(F.col("directional_model").isNull()).select(
        *PAIR, "best_model",
        F.lit("unsupported").alias("status"),
        F.lit(0.0).alias("asymmetric_model_weight"),
        F.lit(False).alias("optimizer_stable"),
        F.lit(NOT_DIRECTIONAL).alias("decision_reason"),
    )
    labelled = called.withColumnsRenamed({"m_a_to_b": "m_a_to_b_scaled", "m_b_to_a": "m_b_to_a_scaled"})
    labelled = labelled.unionByName(other, allowMissingColumns=True)
    corner = (F.col("i") + F.col("j") == 0) | (F.col("i") + F.col("j") == 2 * size)
    informative = cells.filter((F.col("mass") != 0) & ~corner).select(*PAIR, F.lit(True).alias("_informative")).distinct()
    joined = base.join(labelled, PAIR, "left").join(informative, PAIR, "left")
    open_ = F.col("status").isNull()
    flat = F.col("_informative").isNull()
    status = F.when(none, NO_LOCI).when(open_ & flat, UNINFORMATIVE).when(open_, NOT_FITTED).otherwise(F.col("status"))
    reason = F.when(~none & open_ & flat, UNINFORMATIVE_REASON).when(~none & open_, NOT_FITTED_REASON)
    pairwise = joined.withColumns(
        {"status": status, "decision_reason": F.coalesce("decision_reason", reason)}
    ).drop("_informative")
    return InferResult(pairwise, rankings, cells)


def _with_bootstrap(
    called: DataFrame,
    shared: DataFrame,
    configs: DataFrame,
    options: InferOptions,
    library: DataFrame | None,
    parameters: DataFrame | None,
    estimator: Estimator | None,
) -> DataFrame:
    """Replace provisional labels by decisions on bootstrap evidence."""
    size, replicates = options.projection_chromosomes, options.bootstrap_replicates
    chosen = called.select(*PAIR)
    usable = (F.col("n_a") >= size) & (F.col("n_b") >= size)
    if options.bootstrap_block_bp is None:
        kept = configs.join(chosen, PAIR, "left_semi")
        drawn = resample.resample_loci(kept, replicates, options.seed, size, size)
        units = kept.filter(usable).groupBy(*PAIR).agg(
            F.sum("loci").alias("bootstrap_blocks_used"), F.sum("loci").alias("bootstrap_loci_used")
        )
    else:
        blocks = resample.block_configurations(shared.join(chosen, PAIR, "left_semi"), options.bootstrap_block_bp)
        blocks = materialize(blocks)
        # The stream of a pair follows from its names alone.
        stream = F.conv(F.substring(F.md5(F.concat_ws("|", *PAIR)), 1, 7), 16, 10).cast("long").alias("seed_offset")
        drawn = resample.resample_block_configurations(
            blocks, replicates, options.seed, size, size, offsets=chosen.select(*PAIR, stream)
        )
        units = blocks.filter(usable).groupBy(*PAIR).agg(
            F.count_distinct("chrom", "block").alias("bootstrap_blocks_used"),
            F.sum("loci").alias("bootstrap_loci_used"),
        )
    units = materialize(units)
    keys = [*PAIR, "replicate"]
    if estimator is not None:
        estimates = estimator(drawn, keys)
    else:
        if library is None or parameters is None:
            raise ValueError("bootstrap needs an estimator, or a library with its parameters.")
        entries = library.filter(F.col("model").isin(*models.DIRECTIONAL_MODELS))
        scan = models.library_scan(drawn, entries, size, size, keys, polarized=options.polarized)
        best = models.best_entries(scan, keys).join(parameters.hint("merge"), ["model", "param_id"])
        own = called.select(*PAIR, F.col("directional_model").alias("model"))
        estimates = best.join(own, [*PAIR, "model"]).select(
            *keys, F.col("params")["m_a_to_b"].alias("m_a_to_b"), F.col("params")["m_b_to_a"].alias("m_b_to_a")
        )
    estimates = materialize(estimates)
    boot = resample.bootstrap_summary(
        estimates, PAIR, confidence=options.confidence, attempted=replicates, on_too_few="drop"
    )
    support = directional_support(F.col("probability_a_to_b_stronger"), F.col("m_a_to_b"), F.col("m_b_to_a"))
    joined = called.drop("status", "preferred_direction", "decision_reason", "asymmetry_index").join(boot, PAIR).join(
        units, PAIR
    )
    extra = {
        "bootstrap_preferred_direction_support": F.col("preferred_direction_support"),
        "bootstrap_successful": F.col("successful_replicates"),
        "bootstrap_attempted": F.col("attempted_replicates"),
        "bootstrap_resampling_unit": F.lit(resample.resampling_unit_label(options.bootstrap_block_bp)),
    }
    passed = [
        *PAIR, "best_model", "directional_model", "m_a_to_b", "m_b_to_a", "optimizer_success_fraction",
        "probability_a_to_b_stronger", "m_a_to_b_lower", "m_a_to_b_upper", "m_b_to_a_lower", "m_b_to_a_upper",
        *extra, "bootstrap_blocks_used", "bootstrap_loci_used",
    ]
    evidence = joined.withColumns(extra).select(
        *passed,
        F.col("population_a").alias("source"),
        F.col("population_b").alias("destination"),
        F.col("m_a_to_b").alias("migration_forward"),
        F.col("m_b_to_a").alias("migration_reverse"),
        support.alias("directional_support"),
        "asymmetric_model_weight",
        "optimizer_stable",
        F.col("m_a_to_b_lower").alias("forward_lower"),
        F.col("m_a_to_b_upper").alias("forward_upper"),
        F.col("m_b_to_a_lower").alias("reverse_lower"),
        F.col("m_b_to_a_upper").alias("reverse_upper"),
    )
    # Pairs without enough estimates keep their model and rates, and say why they have no decision.
    finite = is_finite(F.col("m_a_to_b")) & is_finite(F.col("m_b_to_a"))
    successes = estimates.groupBy(*PAIR).agg(F.count_if(finite).alias("bootstrap_successful"))
    undecided = called.join(boot.select(*PAIR), PAIR, "left_anti").join(successes, PAIR, "left").join(units, PAIR, "left").select(
        *PAIR, "best_model", "directional_model", "m_a_to_b", "m_b_to_a", "optimizer_success_fraction",
        "asymmetric_model_weight", "optimizer_stable",
        F.lit("unsupported").alias("status"), F.lit(FEW_ESTIMATES).alias("decision_reason"),
        F.coalesce("bootstrap_successful", F.lit(0)).cast("long").alias("bootstrap_successful"),
        F.lit(replicates).cast("long").alias("bootstrap_attempted"),
        F.lit(resample.resampling_unit_label(options.bootstrap_block_bp)).alias("bootstrap_resampling_unit"),
        "bootstrap_blocks_used", "bootstrap_loci_used",
    )
    decided = decisions.classify_direction(
        evidence,
        min_model_weight=options.min_model_weight,
        min_directional_support=options.min_directional_support,
        min_abs_asymmetry=options.min_abs_asymmetry,
        require_interval_separation=True,
        keep=passed,
    )
    decided = decided.drop("source", "destination", "migration", "reverse_migration").withColumnRenamed(
        "reason", "decision_reason"
    )
    return decided.unionByName(undecided, allowMissingColumns=True)


def run_metadata(spark: SparkSession, options: InferOptions, thresholds_source: str | None = None) -> DataFrame:
    """One row with the resolved settings and the labels derived from them."""
    values = {
        **asdict(options),
        "bootstrap_resampling_unit": resample.resampling_unit_label(options.bootstrap_block_bp),
        "spectrum_orientation": options.orientation,
        "thresholds_source": thresholds_source,
        "direction_status_note": STATUS_NOTE,
    }
    types = {int: "long", float: "double", bool: "boolean", str: "string"}
    nullable = {"k_nearest": "long", "max_distance_km": "double", "bootstrap_block_bp": "long", "thresholds_source": "string"}
    fields = [f"{name} {nullable.get(name) or types[type(value)]}" for name, value in values.items()]
    row = tuple(
        float(v) if nullable.get(n) == "double" and v is not None else v for n, v in values.items()
    )
    return spark.createDataFrame([row], ", ".join(fields))


def run_pipeline(
    spark: SparkSession,
    vcf_path: str | list[str],
    popmap_path: str,
    coordinates_path: str,
    output_folder: str,
    options: InferOptions,
    *,
    library: DataFrame | None = None,
    parameters: DataFrame | None = None,
    estimator: Estimator | None = None,
    thresholds_path: str | None = None,
    partitions: int | None = None,
) -> InferResult:
    """The whole run; each stage is a table in the output folder that the next one reads."""
    options.checked()
    if thresholds_path:
        options = with_thresholds(options, tables.load_thresholds(spark, thresholds_path)).checked()
    popmap = tables.read_popmap(spark, popmap_path)
    coordinates = tables.read_coordinates(spark, coordinates_path, unique=False)
    tables.missing_coordinates(popmap, coordinates)

    counted = vcf.allele_counts_from_vcf(
        spark, vcf_path, popmap, min_called_chromosomes=options.min_called_chromosomes, partitions=partitions
    )
    work = f"{output_folder.rstrip('/')}/work-{uuid.uuid4().hex}"  # of this run alone; removed at its end
    counts = spark.read.parquet(sinks.write_allele_counts(counted, output_folder))
    mapped = coordinates.join(popmap.select("population").distinct(), "population", "left_semi")
    pairs = geography.candidate_pairs(
        mapped, max_distance_km=options.max_distance_km, k_nearest=options.k_nearest
    )
    pairs = spark.read.parquet(sinks.write_table(pairs, output_folder, "candidate_pairs"))
    result = infer_pairs(
        counts, pairs, options, library=library, parameters=parameters, estimator=estimator,
        work_folder=work,
    )
    cells = spark.read.parquet(sinks.write_spectra(result.spectra, output_folder))
    pairwise = spark.read.parquet(sinks.write_table(result.pairwise, output_folder, "pairwise_results"))
    rankings = None
    if result.rankings is not None:
        rankings = spark.read.parquet(sinks.write_table(result.rankings, output_folder, "model_rankings"))
    if options.bootstrap_replicates >= 2 and not options.prepare_only:
        flows = decisions.pairwise_to_flows(pairwise)
        sinks.write_table(flows, output_folder, "directional_flows")
        # The network leaves ambiguous edges out; the map layer shows them dashed.
        sinks.write_table(
            network.source_sink_summary(network.network_edges(flows)), output_folder, "network_summary"
        )
        sinks.write_table(
            network.map_edges(mapped, flows, include_ambiguous=True), output_folder, "map_edges"
        )
    sinks.write_table(run_metadata(spark, options, thresholds_path), output_folder, "run_metadata")
    files = [vcf_path] if isinstance(vcf_path, str) else list(vcf_path)
    inputs = {f"vcf_{k}": path for k, path in enumerate(files)} if len(files) > 1 else {"vcf": files[0]}
    inputs |= {"popmap": popmap_path, "coordinates": coordinates_path}
    sinks.write_table(inventory.input_records(spark, inputs), output_folder, "input_records")
    remove_folder(spark, work)
    return InferResult(pairwise, rankings, cells)
