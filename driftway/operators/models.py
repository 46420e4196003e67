"""Demographic model comparison: fit runs, information criteria, likelihood scans, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftway.functions.checks import enforce, is_finite, require_columns
from driftway.functions.special import chi2_one_quantile, log_gamma1p
from driftway.operators.ranking import bucketed_rank, linear_quantiles
from driftway.operators.resample import Estimator
from driftway.operators.spectra import PAIR, fold_spectra
from driftway.session import BROADCAST_ROWS, fits_in_broadcast, materialize

# Parameters of each candidate model, and (initial, lower, upper) of each parameter.
MODEL_PARAMETERS = {
    "isolation": ("nu_a", "nu_b", "split_time"),
    "symmetric_migration": ("nu_a", "nu_b", "split_time", "migration"),
    "asymmetric_migration": ("nu_a", "nu_b", "split_time", "m_a_to_b", "m_b_to_a"),
    "secondary_contact_symmetric": ("nu_a", "nu_b", "isolation_time", "contact_time", "migration"),
    "secondary_contact_asymmetric": (
        "nu_a", "nu_b", "isolation_time", "contact_time", "m_a_to_b", "m_b_to_a",
    ),
}
PARAMETER_BOUNDS = {
    "nu_a": (1.0, 1e-3, 100.0),
    "nu_b": (1.0, 1e-3, 100.0),
    "split_time": (0.5, 1e-4, 20.0),
    "isolation_time": (0.5, 1e-4, 20.0),
    "contact_time": (0.2, 1e-4, 20.0),
    "migration": (0.5, 1e-5, 50.0),
    "m_a_to_b": (0.5, 1e-5, 50.0),
    "m_b_to_a": (0.5, 1e-5, 50.0),
}
DIRECTIONAL_MODELS = ("asymmetric_migration", "secondary_contact_asymmetric")

_NEAR_BUCKETS = 256
_LIBRARY_SALTS = 64
_SLOT_BUCKETS = 256
# Spectra carried side by side in one row.
_LANES = 8


def model_specs(spark: SparkSession) -> DataFrame:
    """The candidate models as rows (model, position, parameter, initial, lower, upper)."""
    rows = [
        (model, position, name, *PARAMETER_BOUNDS[name])
        for model, names in MODEL_PARAMETERS.items()
        for position, name in enumerate(names)
    ]
    return spark.createDataFrame(
        rows, "model string, position int, parameter string, initial double, lower double, upper double"
    )


def aic(log_likelihood: Column, parameters: Column) -> Column:
    return 2.0 * parameters - 2.0 * log_likelihood


def aicc(log_likelihood: Column, parameters: Column, observations: Column) -> Column:
    """Small-sample AIC; infinite when there are too few observations."""
    room = observations - parameters - 1
    correction = 2.0 * parameters * (parameters + 1) / room
    return F.when(room <= 0, F.lit(float("inf"))).otherwise(aic(log_likelihood, parameters) + correction)


def rank_models(scores: DataFrame, keys: list[str] = PAIR, *, use_aicc: bool = True) -> DataFrame:
    """Criterion, delta, Akaike weight and rank of each model within its key.

    A key has one row per candidate model, so its windows are tiny.
    """
    needed = ["model", "log_likelihood", "parameters"] + (["observations"] if use_aicc else [])
    require_columns(scores, [*keys, *needed], "model score table")
    name = "aicc" if use_aicc else "aic"
    ll, count = F.col("log_likelihood"), F.col("parameters")
    criterion = aicc(ll, count, F.col("observations")) if use_aicc else aic(ll, count)
    group = Window.partitionBy(*keys)
    scored = scores.withColumn(name, criterion)
    best = F.min(name).over(group)
    # inf - inf is NaN: an undefined criterion has no finite delta and no weight.
    scored = scored.withColumn("delta", F.col(name) - best)
    raw = F.when(is_finite(F.col("delta")), F.exp(-0.5 * F.col("delta"))).otherwise(0.0)
    scored = scored.withColumn("_raw", raw)
    total = F.sum("_raw").over(group)
    weight = F.when(total > 0, F.col("_raw") / total).otherwise(0.0)
    order = F.row_number().over(group.orderBy(name, "model"))
    return scored.select(
        *keys, "model", "log_likelihood", "parameters", name, "delta",
        weight.alias("akaike_weight"), order.alias("model_rank"),
    )


def best_models(ranking: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """The winner per key; it is directional only if it lets the two rates differ."""
    first = ranking.filter("model_rank = 1")
    directional = F.when(F.col("model").isin(*DIRECTIONAL_MODELS), F.col("model"))
    return first.select(
        *keys,
        F.col("model").alias("best_model"),
        directional.alias("directional_model"),
        F.col("akaike_weight").alias("best_weight"),
    )


def multistart_summary(
    runs: DataFrame,
    keys: list[str],
    *,
    top_fraction: float = 0.25,
    ll_tolerance: float = 2.0,
    spread_tolerance: float = 0.5,
    on_all_failed: str = "raise",
) -> DataFrame:
    """Best run, converged fraction and stability per key (e.g. pair and model).

    Runs need ``run``, ``success``, ``log_likelihood`` and a map ``params``.
    Equal likelihoods rank by run number. Ranks and medians are bucketed, so a key
    with a large share of the runs does not land in one task.
    """
    if not 0 < top_fraction <= 1:
        raise ValueError("top_fraction is a number above 0, and 1 at most.")
    if ll_tolerance < 0 or spread_tolerance < 0:
        raise ValueError("a tolerance is below zero.")
    require_columns(runs, [*keys, "run", "success", "log_likelihood", "params"], "fit-run table")
    ll = F.col("log_likelihood")
    totals = runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if("success").alias("successes"),
        F.max(F.when(F.col("success"), ll)).alias("best_log_likelihood"),
    )
    keep = F.greatest(F.lit(2), F.ceil(F.col("successes") * top_fraction))
    near = runs.filter("success").join(totals, keys).filter(ll >= F.col("best_log_likelihood") - ll_tolerance)
    gap = F.col("best_log_likelihood") - ll
    bucket = F.floor(gap / ll_tolerance * _NEAR_BUCKETS) if ll_tolerance > 0 else F.lit(0)
    ranked = bucketed_rank(near, keys, [bucket], [ll.desc(), F.col("run").asc()])
    # read five times below: written once, or the plan holds the runs and their ranks as often, and the driver plans them all
    kept = materialize(ranked.filter(F.col("rank") <= keep).select(*keys, "run", "params", "rank"))

    values = kept.select(*keys, F.explode("params").alias("parameter", "value"))
    finite = values.withColumn("value", F.when(is_finite(F.col("value")), F.col("value")))
    spans = finite.groupBy(*keys, "parameter").agg(
        F.count("value").alias("n"), F.max("value").alias("high"), F.min("value").alias("low")
    )
    middles = linear_quantiles(finite, [*keys, "parameter"], "value", {"middle": 0.5})
    spread = F.when(
        F.col("n") >= 2,
        (F.col("high") - F.col("low")) / F.greatest(F.abs("middle"), F.lit(1e-12)),
    ).otherwise(F.lit(float("inf")))
    worst = (
        spans.join(middles, [*keys, "parameter"], "left")
        .groupBy(*keys)
        .agg(F.max(spread).alias("largest_spread"))
    )
    best = kept.groupBy(*keys).agg(
        F.count("*").alias("near_best_runs"),
        F.max(F.when(F.col("rank") == 1, F.col("run"))).alias("best_run"),
        F.max_by("params", -F.col("rank")).alias("best_params"),
    )
    stable = (F.col("near_best_runs") >= 2) & F.coalesce(
        F.col("largest_spread") <= spread_tolerance, F.lit(True)
    )
    # From the totals outwards, so that a key without a success is seen here.
    some = F.col("successes") > 0
    table = totals.join(best, keys, "left").join(worst, keys, "left")
    if on_all_failed == "raise":
        table = enforce(table, [(some, "no start of a model's fit succeeded.")])
    else:
        table = table.filter(some)
    return table.select(
        *keys,
        "best_run",
        "best_log_likelihood",
        "best_params",
        (F.col("successes") / F.col("runs")).alias("converged_fraction"),
        "near_best_runs",
        "largest_spread",
        stable.alias("stable"),
    )


def library_scan(
    cells: DataFrame,
    library: DataFrame,
    chromosomes_a: int,
    chromosomes_b: int,
    keys: list[str] = PAIR,
    *,
    polarized: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Log-likelihood of every spectrum under every library entry, at its best scaling.

    ``library`` has rows (model, param_id, i, j, expected) for whole spectra. With
    data d, expectation m and scaling theta = sum d / sum m, the Poisson
    log-likelihood needs one equi-join on the cell: sum d ln m, plus totals of
    either side. An entry that expects nothing in a cell with data scores -inf.

    The spectra are broadcast if they are small enough, and then a library that is
    partitioned by entry already is not shuffled; any other one is, by its folded cells.
    Else the library is broadcast if it is small, or the few hundred cell keys are salted.
    """
    entry = ["model", "param_id"]
    by_entry = library.select(*entry, "i", "j", "expected")
    expected = fold_spectra(by_entry, chromosomes_a, chromosomes_b, entry, value="expected", polarized=polarized)
    data = fold_spectra(cells, chromosomes_a, chromosomes_b, keys, polarized=polarized).filter("mass > 0")
    # A few hundred cells per spectrum, read three times below.
    data = materialize(data)

    totals = expected.groupBy(*entry).agg(F.sum("expected").alias("model_total"))
    facts = data.groupBy(*keys).agg(
        F.sum("mass").alias("data_total"),
        F.sum(log_gamma1p(F.col("mass"))).alias("constant"),
        F.count("*").alias("data_cells"),
    )
    shuffled = F.xxhash64(*keys)
    facts = materialize(
        bucketed_rank(facts, [], [F.pmod(shuffled, F.lit(_SLOT_BUCKETS))], [shuffled, *map(F.col, keys)], "slot")
    )
    # Spectra travel side by side: a library cell joins once per _LANES of them.
    lanes = range(_LANES)
    placed = data.join(facts.select(*keys, (F.col("slot") - 1).alias("_slot")), keys)
    packed = placed.groupBy(F.floor(F.col("_slot") / _LANES).alias("_group"), "i", "j").agg(
        *[F.sum(F.when(F.col("_slot") % _LANES == k, F.col("mass")).otherwise(0.0)).alias(f"_w{k}") for k in lanes]
    )
    logs = expected.filter("expected > 0").select(*entry, "i", "j", F.log("expected").alias("log_expected"))
    on = ["i", "j"]
    if fits_in_broadcast(packed, max_broadcast_rows):
        met = logs.join(F.broadcast(packed), on)
    elif fits_in_broadcast(logs, max_broadcast_rows):
        met = packed.repartition("_group").join(F.broadcast(logs), on)
    else:
        salted = logs.withColumn("_salt", F.pmod(F.xxhash64(*entry), F.lit(_LIBRARY_SALTS)))
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_LIBRARY_SALTS - 1).cast("long")))
        met = packed.select("*", salts.alias("_salt")).join(salted, [*on, "_salt"])
    sums = met.groupBy(*entry, "_group").agg(
        *[F.sum(F.col(f"_w{k}") * F.col("log_expected")).alias(f"_x{k}") for k in lanes],
        *[F.count_if(F.col(f"_w{k}") > 0).alias(f"_n{k}") for k in lanes],
    )
    pairs = F.array(*[F.struct(F.col(f"_x{k}").alias("cross"), F.col(f"_n{k}").alias("matched")) for k in lanes])
    # a row per library entry on either side: neither goes through the driver
    spread = sums.join(totals.hint("merge"), entry).select(*entry, "model_total", "_group", F.posexplode(pairs).alias("_lane", "sums")).select(
        *entry, "model_total", (F.col("_group") * _LANES + F.col("_lane") + 1).alias("slot"), "sums.*"
    )
    scored = spread.join(facts, "slot")
    theta = F.col("data_total") / F.col("model_total")
    ll = F.col("cross") + F.col("data_total") * F.log(theta) - F.col("data_total") - F.col("constant")
    complete = F.col("matched") == F.col("data_cells")
    return scored.select(
        *keys, *entry,
        F.when(complete, ll).otherwise(F.lit(float("-inf"))).alias("log_likelihood"),
        theta.alias("theta"),
    )


def best_entries(scan: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Best library entry per key and model; the smaller id wins a tie."""
    best = F.max(F.struct("log_likelihood", (-F.col("param_id")).alias("smaller"), "theta"))
    grouped = scan.groupBy(*keys, "model").agg(best.alias("best"))
    return grouped.select(
        *keys, "model",
        (-F.col("best.smaller")).alias("param_id"),
        F.col("best.log_likelihood").alias("log_likelihood"),
        F.col("best.theta").alias("theta"),
    )


def scan_as_runs(scan: DataFrame, parameters: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """A library scan in fit-run form, so that stability rules apply to it.

    ``parameters`` maps (model, param_id) to a ``params`` map.
    """
    ll = F.col("log_likelihood")
    return scan.join(parameters.hint("merge"), ["model", "param_id"]).select(
        *keys, "model", F.col("param_id").alias("run"), is_finite(ll).alias("success"), ll.alias("log_likelihood"),
        "params",
    )


def library_estimator(
    library: DataFrame, parameters: DataFrame, chromosomes_a: int, chromosomes_b: int, *, polarized: bool = False
) -> Estimator:
    """An estimator that reads both rates off the best entry of a one-model library."""

    def estimate(cells: DataFrame, keys: list[str]) -> DataFrame:
        scan = library_scan(cells, library, chromosomes_a, chromosomes_b, keys, polarized=polarized)
        best = best_entries(scan, keys).join(parameters.hint("merge"), ["model", "param_id"])
        return best.select(
            *keys,
            F.col("params")["m_a_to_b"].alias("m_a_to_b"),
            F.col("params")["m_b_to_a"].alias("m_b_to_a"),
        )

    return estimate


def profile_scan(
    scan: DataFrame, parameters: DataFrame, parameter: str, keys: list[str] = PAIR, *, model: str = "asymmetric_migration"
) -> DataFrame:
    """Best log-likelihood at each fixed value of one parameter, over all the others."""
    if parameter not in ("m_a_to_b", "m_b_to_a"):
        raise ValueError("profiles run along m_a_to_b or m_b_to_a.")
    fixed = parameters.filter(F.col("model") == model).select(
        "model", "param_id", F.col("params")[parameter].alias("fixed_value")
    )
    return scan.join(fixed, ["model", "param_id"]).groupBy(*keys, "fixed_value").agg(
        F.max("log_likelihood").alias("log_likelihood")
    )


def profile_deltas(profile: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Distance of each profile point from the best finite one."""
    finite = is_finite(F.col("log_likelihood"))
    top = profile.groupBy(*keys).agg(F.max(F.when(finite, F.col("log_likelihood"))).alias("maximum"))
    joined = profile.join(top, keys)
    return joined.withColumn("delta_log_likelihood", F.col("maximum") - F.col("log_likelihood")).drop("maximum")


def profile_interval(profile: DataFrame, keys: list[str] = PAIR, *, confidence: float = 0.95) -> DataFrame:
    """Profile-likelihood interval: fixed values within half a chi-square quantile of the best."""
    if not 0 < confidence < 1:
        raise ValueError("confidence is a number above 0 and below 1.")
    require_columns(profile, [*keys, "fixed_value", "log_likelihood"], "profile table")
    value, ll = F.col("fixed_value"), F.col("log_likelihood")
    usable = is_finite(value) & is_finite(ll)
    top = profile.groupBy(*keys).agg(F.max(F.when(usable, ll)).alias("maximum_log_likelihood"))
    cutoff = 0.5 * chi2_one_quantile(confidence)
    inside = F.when(usable & (ll >= F.col("maximum_log_likelihood") - cutoff), value)
    return profile.join(top, keys).groupBy(*keys).agg(
        F.max("maximum_log_likelihood").alias("maximum_log_likelihood"),
        F.min(inside).alias("lower"),
        F.max(inside).alias("upper"),
    )
