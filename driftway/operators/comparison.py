"""Side-by-side comparison of methods on the same known-truth replicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftway import __version__
from driftway.functions.checks import as_number, enforce, first_values, is_finite, require_columns, require_unit_interval
from driftway.functions.rates import nearly_equal
from driftway.operators import metrics

KEY = ["scenario", "replicate"]
# Methods that one long has bits for.
_BITS = 60
NUMBERS = ("truth_m_a_to_b", "truth_m_b_to_a", "estimated_m_a_to_b", "estimated_m_b_to_a")


def validate_method_table(table: DataFrame, method: str) -> DataFrame:
    """One method's rows, labelled; rows without all four rates are left out."""
    require_columns(table, [*KEY, *NUMBERS], f"{method} comparator table")
    typed = table.withColumns({name: as_number(table, name) for name in NUMBERS})
    typed = typed.withColumn("method", F.lit(method)).dropna(subset=list(NUMBERS))
    if not typed.limit(1).count():
        raise ValueError(f"{method} has no row that can be compared.")
    repeated = first_values(typed.groupBy(*KEY).count().filter("count > 1"), *KEY)
    if repeated:
        raise ValueError(
            f"{method} has several rows for one replicate, e.g. {repeated}."
        )
    signs = [(F.col(name) >= 0, "a true or estimated rate is below zero.") for name in NUMBERS]
    return enforce(typed, signs)


def standardize_benchmark(table: DataFrame, *, estimand: str = "scaled_migration", version: str = __version__) -> DataFrame:
    """A recovery table in the comparison schema, marked with its estimand and version."""
    renamed = table.withColumnsRenamed({"true_m_a_to_b": "truth_m_a_to_b", "true_m_b_to_a": "truth_m_b_to_a"})
    require_columns(renamed, [*KEY, *NUMBERS], "benchmark table")
    return renamed.select(
        *KEY, *NUMBERS, F.lit(estimand).alias("estimand"), F.lit(version).alias("method_version")
    )


def combine_methods(tables: dict[str, DataFrame]) -> DataFrame:
    """Validated union of at least two method tables."""
    if len(tables) < 2:
        raise ValueError("a comparison takes two methods or more.")
    checked = [validate_method_table(table, name) for name, table in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), checked)


def _named_values(column: str) -> Column:
    return F.trim(F.col(column).cast("string"))


def _method_bits(names: list[str]) -> list[Column]:
    """A bit per method in longs of ``_BITS`` bits, set where a key has a row of it."""
    words = []
    for start in range(0, len(names), _BITS):
        bit = F.lit(0).cast("long")
        for k, name in enumerate(names[start : start + _BITS]):
            bit = F.when(F.col("method").eqNullSafe(name), F.lit(1 << k)).otherwise(bit)
        words.append(F.bit_or(bit).alias(f"_bits{start // _BITS}"))
    return words


def _none_first(key: tuple) -> list:
    return [(v is not None, v) for v in key]


def _check_key_sets(per_key: DataFrame, names: list[str], examples: int = 5) -> None:
    """Raises where a method lacks keys of the first one or has others, with the smallest of them.

    Keys that not all methods have are told apart by their bits alone, so one job with a few keys of each pattern
    answers for every method.
    """
    words = range(-(-len(names) // _BITS))
    full = [(1 << len(names[_BITS * k : _BITS * (k + 1)])) - 1 for k in words]
    whole = F.lit(True)
    for k in words:
        whole = whole & (F.col(f"_bits{k}") == full[k])
    order = Window.partitionBy(*[f"_bits{k}" for k in words]).orderBy(*KEY)
    partial = per_key.filter(~whole).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= examples)
    found = [(sum(row[f"_bits{k}"] << (_BITS * k) for k in words), tuple(row[c] for c in KEY)) for row in partial.collect()]
    for k, name in enumerate(names[1:], 1):
        missing = sorted((key for bits, key in found if bits & 1 and not bits >> k & 1), key=_none_first)[:examples]
        extra = sorted((key for bits, key in found if bits >> k & 1 and not bits & 1), key=_none_first)[:examples]
        if missing or extra:
            raise ValueError(
                f"the replicates of {name} are not those of {names[0]}: it lacks {missing} and has {extra} besides (up to {examples} each)."
            )


def matched_comparison(
    results: DataFrame, *, require_complete_match: bool = True, allow_mixed_estimands: bool = False
) -> DataFrame:
    """The results, after checking that all methods saw the same replicates and truths.

    One aggregate by key serves both checks: a bit per method tells which of them have
    the key. Only violations reach the driver, five keys for each pattern of bits.
    """
    require_columns(results, [*KEY, *NUMBERS, "method"], "comparison results")
    truths = [c for c in NUMBERS if c.startswith("truth")]
    names = [row[0] for row in results.select("method").distinct().orderBy("method").collect()]
    per_key = results.groupBy(*KEY).agg(
        *_method_bits(names),
        *[F.min(c).alias(f"low_{c}") for c in truths],
        *[F.max(c).alias(f"high_{c}") for c in truths],
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in truths],
        F.count("*").alias("rows"),
    )
    differs = F.lit(False)
    for c in truths:
        mixed = (F.col(f"nulls_{c}") > 0) & (F.col(f"nulls_{c}") < F.col("rows"))
        differs = differs | mixed | F.coalesce(F.col(f"low_{c}") != F.col(f"high_{c}"), F.lit(False))
    clash = first_values(per_key.filter(differs), *KEY, limit=1)
    if clash:
        scenario, replicate = clash[0]
        raise ValueError(
            f"replicate {replicate!r} of scenario {scenario!r} has another truth under another method."
        )
    if require_complete_match:
        _check_key_sets(per_key, names)
    if "estimand" in results.columns and not allow_mixed_estimands:
        named = results.select(_named_values("estimand").alias("estimand")).filter("estimand <> ''")
        found = [row[0] for row in first_values(named, "estimand", limit=100)]
        if len(found) > 1:
            raise ValueError(
                "the methods estimate different quantities: " + ", ".join(found)
                + "; convert them to one, or compare them apart."
            )
    return results


def summarize_methods(
    results: DataFrame, *, direction_only: bool = False, asymmetry_threshold: float = metrics.ASYMMETRY_THRESHOLD
) -> DataFrame:
    """Accuracy per method and scenario; direction only leaves the magnitude metrics out."""
    require_columns(results, [*KEY, *NUMBERS, "method"], "comparison results")
    require_unit_interval(asymmetry_threshold=asymmetry_threshold)
    t_ab, t_ba, e_ab, e_ba = (F.col(c) for c in NUMBERS)
    finite = reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in NUMBERS])
    checked = enforce(results, [(finite, "a truth or estimate is not a finite number.")])
    magnitude = [] if direction_only else [
        metrics.bias(t_ab, e_ab).alias("bias_m_a_to_b"),
        metrics.rmse(t_ab, e_ab).alias("rmse_m_a_to_b"),
        metrics.bias(t_ba, e_ba).alias("bias_m_b_to_a"),
        metrics.rmse(t_ba, e_ba).alias("rmse_m_b_to_a"),
    ]
    table = checked.groupBy("method", "scenario").agg(
        F.count("*").alias("replicates"),
        *magnitude,
        metrics.share(metrics.same_direction(t_ab, t_ba, e_ab, e_ba)).alias("direction_accuracy"),
        metrics.share(metrics.calls_direction(e_ab, e_ba, asymmetry_threshold)).alias("_called"),
        F.bool_and(nearly_equal(t_ab, t_ba)).alias("_symmetric"),
    )
    rate = F.when(F.col("_symmetric"), F.col("_called"))
    return table.withColumn("false_directional_positive_rate", rate).drop("_called", "_symmetric")


def comparison_metadata(
    results: DataFrame,
    *,
    direction_only: bool = False,
    require_complete_match: bool = True,
    asymmetry_threshold: float = metrics.ASYMMETRY_THRESHOLD,
) -> DataFrame:
    """One row: run options, methods, distinct estimands and the versions of each method."""
    spaced = results
    for name in ("estimand", "method_version"):
        value = _named_values(name) if name in results.columns else F.lit(None).cast("string")
        spaced = spaced.withColumn(name, F.when(value != "", value))
    # A handful of distinct labels survive this step.
    labels = spaced.select("method", "estimand", "method_version").distinct()
    per_method = labels.groupBy("method").agg(
        F.sort_array(F.collect_set("method_version")).alias("versions"), F.collect_set("estimand").alias("estimands")
    )
    return per_method.agg(
        F.lit(direction_only).alias("direction_only"),
        F.lit(require_complete_match).alias("require_complete_match"),
        F.lit(asymmetry_threshold).alias("asymmetry_threshold"),
        F.sort_array(F.collect_set("method")).alias("methods"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("estimands")))).alias("estimands"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "versions")))).alias("method_versions"),
        F.lit(not direction_only).alias("magnitude_metrics_reported"),
    )


def method_pivot(summary: DataFrame, measure: str = "direction_accuracy", methods: list[str] | None = None) -> DataFrame:
    """Scenarios by method: accuracy where the truth is directional, false-direction rate where it is symmetric."""
    symmetric = F.col("false_directional_positive_rate").isNotNull()
    shown = summary.filter(symmetric if measure == "false_directional_positive_rate" else ~symmetric)
    grouped = shown.groupBy("scenario")
    pivoted = grouped.pivot("method", methods) if methods else grouped.pivot("method")
    return pivoted.agg(F.avg(measure))
