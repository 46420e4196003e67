"""The registered queries as DuckDB statements, written independently of the operators."""

from __future__ import annotations

from decimal import Decimal, localcontext

from driftway.plans.fixtures import as_ctes

SIZE = 8
BLOCK_BP = 250_000
REPLICATES = 20
NE = 500


def _lnf(n: str) -> str:
    return f"lgamma(CAST({n} AS DOUBLE) + 1)"


def _pmf(k: str, called: str, alt: str, target: int = SIZE) -> str:
    """Hypergeometric weight, 0 outside its support."""
    rest = f"({called} - {alt})"
    weight = (
        f"{_lnf(alt)} - {_lnf(k)} - {_lnf(f'({alt} - {k})')} + {_lnf(rest)} - {_lnf(f'({target} - {k})')}"
        f" - {_lnf(f'({rest} - {target} + {k})')} - {_lnf(called)} + {_lnf(target)} + {_lnf(f'({called} - {target})')}"
    )
    return f"CASE WHEN {k} <= {alt} AND {target} - {k} <= {rest} THEN exp({weight}) ELSE 0 END"


def _haversine(a: str, b: str) -> str:
    lat = f"radians({b}.latitude - {a}.latitude) / 2"
    lon = f"radians({b}.longitude - {a}.longitude) / 2"
    return (
        f"2 * 6371.0088 * asin(sqrt(sin({lat}) * sin({lat}) + cos(radians({a}.latitude)) * "
        f"cos(radians({b}.latitude)) * sin({lon}) * sin({lon})))"
    )


def _asym(x: str, y: str) -> str:
    return f"CASE WHEN {x} + {y} = 0 THEN 0.0 ELSE ({x} - {y}) / ({x} + {y}) END"


# Shared stages.

COUNTS = as_ctes("counts")
SHARED = COUNTS + """,
shared AS (
  SELECT a.population AS population_a, b.population AS population_b, chrom, pos, ref, alt,
         a.called_chromosomes AS n_a, a.alt_count AS x_a, b.called_chromosomes AS n_b, b.alt_count AS x_b
  FROM counts a JOIN counts b USING (chrom, pos, ref, alt) WHERE a.population < b.population)"""
PAIRS = SHARED + """,
pairs AS (SELECT a.r_name AS population_a, b.r_name AS population_b FROM region a JOIN region b ON a.r_name < b.r_name),
seen AS (
  SELECT population_a, population_b, count(DISTINCT (chrom, pos, ref, alt)) AS either
  FROM pairs JOIN counts ON population IN (population_a, population_b) GROUP BY ALL)"""
MODES = SHARED + """,
mode_a AS (SELECT population_a, population_b, n_a AS n FROM (
  SELECT population_a, population_b, n_a, count(*) AS c FROM shared GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY population_a, population_b ORDER BY c DESC, n_a) = 1),
mode_b AS (SELECT population_a, population_b, n_b AS n FROM (
  SELECT population_a, population_b, n_b, count(*) AS c FROM shared GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY population_a, population_b ORDER BY c DESC, n_b) = 1)"""
EXACT = MODES + """,
exact AS (
  SELECT s.population_a, s.population_b, a.n AS chromosomes_a, b.n AS chromosomes_b, x_a AS i, x_b AS j,
         count(*) AS mass
  FROM shared s JOIN mode_a a USING (population_a, population_b) JOIN mode_b b USING (population_a, population_b)
  WHERE n_a = a.n AND n_b = b.n GROUP BY ALL)"""


def _cells(source: str, keys: str, name: str = "cells", weight: str = "1") -> str:
    """Projected cells of locus rows, each with mass ``weight``."""
    return f""",
{name} AS (
  SELECT {keys}, i, j, sum({weight} * {_pmf('i', 'n_a', 'x_a')} * {_pmf('j', 'n_b', 'x_b')}) AS mass
  FROM {source} CROSS JOIN (SELECT unnest(range(0, {SIZE + 1})) AS i) CROSS JOIN
       (SELECT unnest(range(0, {SIZE + 1})) AS j)
  WHERE n_a >= {SIZE} AND n_b >= {SIZE} GROUP BY ALL HAVING sum({weight} * {_pmf('i', 'n_a', 'x_a')} *
        {_pmf('j', 'n_b', 'x_b')}) > 0)"""


PAIR = "population_a, population_b"
PROJECTED = SHARED + _cells("shared", PAIR)
INNER = f"NOT (i = 0 AND j = 0) AND NOT (i = {SIZE} AND j = {SIZE})"


def _folded(cells: str, keys: str, name: str, value: str = "mass") -> str:
    return f""",
{name} AS (
  SELECT {keys}, i, j, sum({value}) AS {value} FROM (
    SELECT {keys}, i, j, CASE WHEN 2 * (i + j) = {2 * SIZE} THEN {value} / 2 ELSE {value} END AS {value}
    FROM {cells} WHERE {INNER} AND i + j <= {SIZE}
    UNION ALL
    SELECT {keys}, {SIZE} - i, {SIZE} - j, CASE WHEN 2 * (i + j) = {2 * SIZE} THEN {value} / 2 ELSE {value} END
    FROM {cells} WHERE {INNER} AND i + j >= {SIZE}) GROUP BY ALL)"""


FOLDED = PROJECTED + _folded("cells", PAIR, "folded")
BLOCKED = SHARED + f""",
blocked AS (SELECT *, (pos - 1) // {BLOCK_BP} AS block FROM shared)"""
BLOCK_CELLS = BLOCKED + _cells("blocked", f"{PAIR}, chrom, block", "block_cells")


def _ordinals(source: str) -> str:
    return f""",
ordinals AS (
  SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY chrom, block) - 1 AS ordinal
  FROM (SELECT DISTINCT {PAIR}, chrom, block FROM {source}))"""


WEIGHTS = f""",
sizes AS (SELECT {PAIR}, count(*) AS n FROM ordinals GROUP BY ALL),
weights AS (
  SELECT {PAIR}, replicate, CAST(concat('0x', substr(md5(concat_ws(':', 42, replicate, draw)), 1, 12)) AS BIGINT) % n
         AS ordinal, count(*) AS weight
  FROM (SELECT *, unnest(range(0, n)) AS draw FROM
        (SELECT *, unnest(range(0, {REPLICATES})) AS replicate FROM sizes)) GROUP BY ALL)"""
REPLICATE_CELLS = BLOCK_CELLS + _ordinals("block_cells") + WEIGHTS + f""",
replicate_cells AS (
  SELECT {PAIR}, replicate, i, j, sum(weight * mass) AS mass
  FROM weights JOIN ordinals USING ({PAIR}, ordinal) JOIN block_cells USING ({PAIR}, chrom, block) GROUP BY ALL)"""

def _poisson_ends() -> str:
    """Where Poisson(1) weights 0, 1, ... end on a scale of 2**48."""
    with localcontext(prec=60):
        share, total, ends = Decimal(-1).exp(), Decimal(0), []
        for k in range(17):
            total += share
            share /= k + 1
            ends.append(int(total * 2**48))
    return str(ends)


POISSON_CELLS = BLOCK_CELLS + f""",
drawn AS (
  SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', 42, replicate, {PAIR}, chrom, block)), 1, 12)) AS BIGINT) AS draw
  FROM (SELECT DISTINCT {PAIR}, chrom, block FROM block_cells) CROSS JOIN (SELECT unnest(range(0, {REPLICATES})) AS replicate)),
weights AS (SELECT *, len(list_filter({_poisson_ends()}, lambda e: e <= draw)) AS weight FROM drawn),
replicate_cells AS (
  SELECT {PAIR}, replicate, i, j, sum(weight * mass) AS mass
  FROM weights JOIN block_cells USING ({PAIR}, chrom, block) WHERE weight > 0 GROUP BY ALL)"""

_MASK = "18446744073709551616::UHUGEINT"


def _mixed(x: str) -> str:
    """A 64-bit mix of an unsigned number."""

    def times(y: str, factor: int) -> str:
        return f"(({y}::UHUGEINT * {factor}::UHUGEINT) % {_MASK})::UBIGINT"

    one = times(f"xor({x}, {x} >> 30)", 0xBF58476D1CE4E5B9)
    return f"(SELECT xor(b, b >> 31) FROM (SELECT {times('xor(a, a >> 27)', 0x94D049BB133111EB)} AS b FROM (SELECT {one} AS a)))"


def _tree_draws(units: str, keys: str, order: str, replicates: int, levels: int = 15, seed: int = 42) -> str:
    """Multinomial draws of the rows of ``units`` (keys, unit, c): a binary tree of binomials inverted at hashes.

    The last table, ``drawn``, has the rows of ``units`` with replicate and weight.
    """
    by = f"{keys}, " if keys else ""
    using = f"{keys}, " if keys else ""
    named = f"concat_ws('|', {seed}, {keys})" if keys else f"'{seed}'"
    part = f"PARTITION BY {keys}" if keys else ""
    out = f""",
leaves AS MATERIALIZED (SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS idx FROM {units}),
t0 AS MATERIALIZED (SELECT {by}idx, c AS total FROM leaves)"""
    for level in range(1, levels + 1):
        out += f""",
t{level} AS MATERIALIZED (SELECT {by}idx // 2 AS idx, CAST(sum(total) AS BIGINT) AS total FROM t{level - 1} GROUP BY ALL)"""
    out += f""",
d{levels} AS MATERIALIZED (
  SELECT {by}replicate, idx, total AS n, {_mixed('(stream + replicate)::UBIGINT')} AS own
  FROM (SELECT *, CAST(concat('0x', substr(md5({named}), 1, 15)) AS BIGINT) AS stream,
               unnest(range(0, {replicates})) AS replicate FROM t{levels}))"""
    for level in range(levels, 0, -1):
        at = f"((own::UHUGEINT + {level << 40}::UHUGEINT + idx::UHUGEINT) % {_MASK})::UBIGINT"
        out += f""",
p{level} AS MATERIALIZED (
  SELECT {by}replicate, idx, n, own, coalesce(b.total, 0) / a.total AS p, ({_mixed(at)} >> 12)::DOUBLE / 4503599627370496 + 0.5 / 4503599627370496 AS u
  FROM d{level} JOIN t{level} a USING ({using}idx) LEFT JOIN (SELECT {by}idx // 2 AS idx, total FROM t{level - 1} WHERE idx % 2 = 0) b USING ({using}idx)),
k{level} AS (
  SELECT {by}replicate, idx, count(*) FILTER (cdf < u) + min(k) AS k
  FROM (SELECT *, sum(w) OVER (PARTITION BY {by}replicate, idx ORDER BY k) / sum(w) OVER (PARTITION BY {by}replicate, idx) AS cdf
        FROM (SELECT *, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) AS w
              FROM (SELECT *, unnest(range(CAST(greatest(floor(n * p - 12 * sqrt(n * p * (1 - p)) - 20), 0) AS BIGINT),
                                           CAST(least(ceil(n * p + 12 * sqrt(n * p * (1 - p)) + 20), n) AS BIGINT) + 1)) AS k
                    FROM p{level} WHERE p > 0 AND p < 1))) GROUP BY ALL),
d{level - 1} AS MATERIALIZED (
  SELECT {by}replicate, child.idx AS idx, child.n AS n, own FROM (
    SELECT {by}replicate, own, unnest([{{'idx': 2 * idx, 'n': k}}, {{'idx': 2 * idx + 1, 'n': n - k}}]) AS child FROM (
      SELECT q.*, coalesce(k.k, CASE WHEN p > 0 THEN n ELSE 0 END) AS k FROM p{level} q LEFT JOIN k{level} k USING ({using}replicate, idx)))
  WHERE child.n > 0)"""
    return out + f""",
drawn AS (SELECT leaves.*, replicate, n AS weight FROM leaves JOIN d0 USING ({using}idx))"""


LOCUS_CELLS = SHARED + f""",
units AS (SELECT {PAIR}, n_a, x_a, n_b, x_b, count(*) AS c FROM shared WHERE n_a >= {SIZE} AND n_b >= {SIZE} GROUP BY ALL)""" + _tree_draws(
    "units", PAIR, "n_a, x_a, n_b, x_b", REPLICATES
) + _cells("drawn", f"{PAIR}, replicate", "replicate_cells", "weight")

DISTANCES = as_ctes("places") + f""",
pairs AS (SELECT a.population AS population_a, b.population AS population_b, a.ord AS ord_a, b.ord AS ord_b,
                 {_haversine('a', 'b')} AS distance_km FROM places a JOIN places b ON a.ord < b.ord),
ends AS (SELECT ord_a AS me, ord_b AS other, * FROM pairs UNION ALL SELECT ord_b, ord_a, * FROM pairs),
near AS (SELECT *, row_number() OVER (PARTITION BY me ORDER BY distance_km, ord_a, ord_b) AS r FROM ends)"""

SCORES = as_ctes("fit_runs") + """,
scores AS (SELECT pair_id, model, max(log_likelihood) AS log_likelihood, max(parameters) AS parameters,
                  max(observations) AS observations FROM fit_runs WHERE success GROUP BY ALL)"""


def _ranking(name: str, criterion: str) -> str:
    return SCORES + f""",
scored AS (SELECT *, {criterion} AS {name} FROM scores),
shifted AS (SELECT *, {name} - min({name}) OVER (PARTITION BY pair_id) AS delta FROM scored),
ranking AS (
  SELECT pair_id, model, log_likelihood, parameters, {name}, delta,
         exp(-delta / 2) / sum(exp(-delta / 2)) OVER (PARTITION BY pair_id) AS akaike_weight,
         CAST(row_number() OVER (PARTITION BY pair_id ORDER BY {name}, model) AS INTEGER) AS model_rank
  FROM shifted)"""


AIC = "2.0 * parameters - 2.0 * log_likelihood"
AICC = f"{AIC} + 2.0 * parameters * (parameters + 1) / (observations - parameters - 1)"

SCAN = FOLDED.replace("WITH ", as_ctes("library_parameters") + ",\n", 1) + f""",
library AS (
  SELECT model, param_id, m_a_to_b, i, j, exp(-abs(i - j) * m_a_to_b / 2) / (1 + i + j)
         + CASE WHEN model = 'asymmetric_migration' THEN 0.01 * j * m_b_to_a ELSE 0 END AS expected
  FROM library_parameters CROSS JOIN (SELECT unnest(range(0, {SIZE + 1})) AS i)
       CROSS JOIN (SELECT unnest(range(0, {SIZE + 1})) AS j))""" + _folded(
    "library", "model, param_id, m_a_to_b", "expectation", "expected"
) + f""",
model_totals AS (SELECT model, param_id, m_a_to_b, sum(expected) AS s FROM expectation GROUP BY ALL),
facts AS (SELECT {PAIR}, sum(mass) AS d, sum(lgamma(mass + 1)) AS c FROM folded WHERE mass > 0 GROUP BY ALL),
crossed AS (SELECT {PAIR}, model, param_id, sum(mass * ln(expected)) AS x FROM folded JOIN expectation USING (i, j)
            WHERE mass > 0 GROUP BY ALL),
scan AS (SELECT {PAIR}, model, param_id, m_a_to_b, x + d * ln(d / s) - d - c AS log_likelihood
         FROM crossed JOIN model_totals USING (model, param_id) JOIN facts USING ({PAIR})),
profile AS (SELECT {PAIR}, m_a_to_b AS fixed_value, max(log_likelihood) AS log_likelihood FROM scan
            WHERE model = 'asymmetric_migration' GROUP BY ALL)"""

REASONS = """concat_ws('; ', CASE WHEN NOT optimizer_stable THEN 'optimizer instability' END,
             CASE WHEN directional_support < {support} THEN 'directional support below threshold' END,
             CASE WHEN abs(a) < {asymmetry} THEN 'asymmetry below threshold' END,
             CASE WHEN NOT {separated} THEN 'uncertainty intervals overlap or are unavailable' END)"""


def _decided(weight: float = 0.70, support: float = 0.95, asymmetry: float = 0.25, separated: str = "TRUE") -> str:
    failed = REASONS.format(support=support, asymmetry=asymmetry, separated=separated)
    return as_ctes("evidence") + f""",
indexed AS (SELECT *, {_asym('migration_forward', 'migration_reverse')} AS a FROM evidence),
judged AS (SELECT *, {failed} AS failed FROM indexed),
decided AS (
  SELECT evidence_id, source, destination,
         CASE WHEN migration_forward = 0 AND migration_reverse = 0 THEN 'unsupported'
              WHEN asymmetric_model_weight < {weight} THEN 'unsupported'
              WHEN failed = '' THEN 'supported' ELSE 'ambiguous' END AS status,
         CASE WHEN migration_forward > migration_reverse THEN source || '->' || destination
              WHEN migration_reverse > migration_forward THEN destination || '->' || source END AS preferred_direction,
         migration_forward AS migration, migration_reverse AS reverse_migration, a AS asymmetry_index,
         directional_support, asymmetric_model_weight, optimizer_stable,
         CASE WHEN migration_forward = 0 AND migration_reverse = 0 THEN 'no migration signal'
              WHEN asymmetric_model_weight < {weight} THEN 'asymmetric model support below threshold'
              WHEN failed = '' THEN 'all directional evidence criteria satisfied' ELSE failed END AS reason
  FROM judged)"""


DECIDED_COLUMNS = """evidence_id, source, destination, status, preferred_direction, round(migration, 9) AS migration,
  round(reverse_migration, 9) AS reverse_migration, round(asymmetry_index, 9) AS asymmetry_index,
  round(directional_support, 9) AS directional_support, round(asymmetric_model_weight, 9) AS asymmetric_model_weight,
  optimizer_stable, reason"""


def _flows(statuses: str) -> str:
    return _decided(support=0.6) + f""",
flows AS (
  SELECT evidence_id, CASE WHEN migration >= reverse_migration THEN source ELSE destination END AS source,
         CASE WHEN migration >= reverse_migration THEN destination ELSE source END AS destination,
         greatest(migration, reverse_migration) AS migration, directional_support AS support, status,
         asymmetry_index, asymmetric_model_weight AS model_weight, reason
  FROM decided WHERE status IN ({statuses}) AND preferred_direction IS NOT NULL)"""


FLOW_COLUMNS = """evidence_id, source, destination, round(migration, 9) AS migration, round(support, 9) AS support, status,
  round(asymmetry_index, 9) AS asymmetry_index, round(model_weight, 9) AS model_weight"""
BOTH = "'supported', 'ambiguous'"

REPLICATE_TABLE = as_ctes("replicates")
SIGN = "sign(truth_m_a_to_b - truth_m_b_to_a) = sign(estimated_m_a_to_b - estimated_m_b_to_a)"
CALLS = f"abs({_asym('estimated_m_a_to_b', 'estimated_m_b_to_a')}) >= 0.25"


def _share(condition: str, where: str | None = None) -> str:
    value = f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"
    return f"avg({value})" if where is None else f"avg(CASE WHEN {where} THEN {value} END)"


def _errors(side: str, where: str | None = None, digits: int = 8) -> str:
    gap = f"(estimated_m_{side} - truth_m_{side})"
    kept = gap if where is None else f"CASE WHEN {where} THEN {gap} END"
    return (
        f"round(avg({kept}), {digits}) AS bias_m_{side}, "
        f"round(sqrt(avg({kept} * {kept})), {digits}) AS rmse_m_{side}"
    )


SIGNALS = as_ctes("stress_replicates") + f""",
zeroed AS (
  SELECT *, CASE WHEN directional_model IS NULL THEN 0 ELSE m_a_to_b END AS e_ab,
         CASE WHEN directional_model IS NULL THEN 0 ELSE m_b_to_a END AS e_ba,
         CASE WHEN directional_model IS NULL THEN 0 ELSE best_weight END AS w,
         directional_model IS NOT NULL AND stable AS ok FROM stress_replicates),
signals AS (
  SELECT scenario, replicate, expected_direction, success, grid_cell, best_model, directional_model, generating_model,
         w AS asymmetric_model_weight, e_ab AS estimated_m_a_to_b, e_ba AS estimated_m_b_to_a,
         {_asym('e_ab', 'e_ba')} AS estimated_asymmetry,
         CASE WHEN directional_model IS NULL THEN 'none' WHEN e_ab > e_ba THEN 'A->B' WHEN e_ba > e_ab THEN 'B->A'
              ELSE 'symmetric' END AS preferred_direction,
         ok AS asymmetric_optimizer_stable,
         w >= 0.7 AND ok AND abs({_asym('e_ab', 'e_ba')}) >= 0.25 AS provisional_directional_signal,
         best_model = generating_model AS correct_model_selected
  FROM zeroed)"""
SUCCESS = """count(*) AS attempted_replicates, count(*) FILTER (success) AS successful_replicates,
  round(count(*) FILTER (success) / count(*), 6) AS success_rate"""


def _stress(keys: str) -> str:
    return SIGNALS + f"""
SELECT {keys}, {SUCCESS},
  round({_share('correct_model_selected', 'success')}, 6) AS correct_model_selection_rate,
  round({_share('provisional_directional_signal', 'success')}, 6) AS provisional_directional_signal_rate,
  CASE WHEN min(expected_direction) <> 'symmetric' THEN
    round({_share('provisional_directional_signal AND preferred_direction = expected_direction', 'success')}, 6) END
    AS direction_recovery_rate,
  CASE WHEN min(expected_direction) = 'symmetric' THEN
    round({_share('provisional_directional_signal', 'success')}, 6) END AS false_direction_signal_rate
FROM signals GROUP BY ALL"""


COVERAGE = as_ctes("bootstrap_replicates") + f""",
coverage AS (
  SELECT *, true_m_a_to_b * 20000 BETWEEN m_a_to_b_lower AND m_a_to_b_upper AS coverage_a_to_b,
         true_m_b_to_a * 20000 BETWEEN m_b_to_a_lower AND m_b_to_a_upper AS coverage_b_to_a,
         m_a_to_b_upper - m_a_to_b_lower AS interval_width_a_to_b,
         m_b_to_a_upper - m_b_to_a_lower AS interval_width_b_to_a,
         CASE WHEN success THEN {_asym('m_a_to_b_mean', 'm_b_to_a_mean')} END AS estimated_asymmetry,
         preferred_direction_support >= 0.95 AND abs({_asym('m_a_to_b_mean', 'm_b_to_a_mean')}) >= 0.25
           AS strong_directional_support
  FROM bootstrap_replicates)"""


def _linkage(keys: str, source: str = "") -> str:
    return COVERAGE + f""",
linkage AS (
  SELECT {keys}, scenario, method, count(*) AS attempted_replicates,
    count(*) FILTER (success) AS successful_replicates, count(*) FILTER (success) / count(*) AS success_rate,
    {_share('coverage_a_to_b', 'success')} AS coverage_a_to_b, {_share('coverage_b_to_a', 'success')} AS coverage_b_to_a,
    avg(interval_width_a_to_b) AS mean_interval_width_a_to_b, avg(interval_width_b_to_a) AS mean_interval_width_b_to_a,
    {_share('strong_directional_support', 'success')} AS strong_directional_support_rate,
    CASE WHEN min(expected_direction) = 'symmetric' THEN {_share('strong_directional_support', 'success')} END
      AS false_directional_support_rate
  FROM coverage GROUP BY ALL)"""


LINKED = _linkage("0 AS unused")
LINKED_GRID = _linkage("round(recombination_rate * 1e9, 3) AS recombination_rate")
LINKAGE_COLUMNS = """scenario, method, attempted_replicates, successful_replicates, round(success_rate, 9) AS success_rate,
  round(coverage_a_to_b, 9) AS coverage_a_to_b, round(coverage_b_to_a, 9) AS coverage_b_to_a,
  round(mean_interval_width_a_to_b, 9) AS mean_interval_width_a_to_b,
  round(mean_interval_width_b_to_a, 9) AS mean_interval_width_b_to_a,
  round(strong_directional_support_rate, 9) AS strong_directional_support_rate,
  round(false_directional_support_rate, 9) AS false_directional_support_rate"""

CALLED = """optimizer_stable AND interval_separated AND asymmetric_model_weight >= w AND directional_support >= s
            AND abs(asymmetry_index) >= a AND preferred_direction IN ('A->B', 'B->A')"""


def _thresholds(weights: str, supports: str, asymmetries: str) -> str:
    return as_ctes("evidence") + f""",
grid AS (SELECT unnest({weights}::DOUBLE[]) AS w),
grid2 AS (SELECT w, unnest({supports}::DOUBLE[]) AS s FROM grid),
grid3 AS (SELECT w, s, unnest({asymmetries}::DOUBLE[]) AS a FROM grid2),
called AS (SELECT w, s, a, truth_direction IN ('A->B', 'B->A') AS directional,
                  preferred_direction = truth_direction AS correct, {CALLED} AS called FROM evidence CROSS JOIN grid3),
scan AS (
  SELECT w AS min_model_weight, s AS min_directional_support, a AS min_abs_asymmetry,
    {_share('called', 'NOT directional')} AS false_directional_positive_rate,
    {_share('called AND correct', 'directional')} AS directional_sensitivity,
    {_share('correct', 'directional AND called')} AS direction_accuracy_when_called,
    {_share('called')} AS called_fraction, count(*) AS evaluated_rows,
    count(*) FILTER (NOT directional) AS null_rows, count(*) FILTER (directional) AS directional_rows
  FROM called GROUP BY ALL)"""


SCAN_GRID = _thresholds("[.5,.6,.7,.8,.9]", "[.9,.95,.975,.99]", "[.1,.2,.25,.3,.4]")
ONE_THRESHOLD = _thresholds("[.6]", "[.75]", "[.2]")
SELECTED_COLUMNS = """round(min_model_weight, 6) AS min_model_weight,
  round(min_directional_support, 6) AS min_directional_support, round(min_abs_asymmetry, 6) AS min_abs_asymmetry,
  round(false_directional_positive_rate, 6) AS false_directional_positive_rate,
  round(directional_sensitivity, 6) AS directional_sensitivity,
  round(direction_accuracy_when_called, 6) AS direction_accuracy_when_called,
  round(called_fraction, 6) AS called_fraction, evaluated_rows"""

REGIMES = as_ctes("grid_summary") + """,
tested AS (
  SELECT CAST(chromosomes AS BIGINT) AS chromosomes, CAST(segregating_sites AS BIGINT) AS segregating_sites,
         min(success_rate) AS minimum_success_rate, min(direction_accuracy) AS minimum_direction_accuracy,
         max(false_directional_positive_rate) AS maximum_false_direction_rate,
         coalesce(min(success_rate) >= 0.95 AND min(direction_accuracy) >= 0.95
                  AND max(false_directional_positive_rate) <= 0.045, FALSE) AS passes_targets
  FROM grid_summary GROUP BY ALL)"""


def _front(source: str) -> str:
    return f"""SELECT * FROM {source} p WHERE passes_targets AND NOT EXISTS (
  SELECT 1 FROM {source} q WHERE q.passes_targets AND q.chromosomes <= p.chromosomes
    AND q.segregating_sites <= p.segregating_sites
    AND (q.chromosomes < p.chromosomes OR q.segregating_sites < p.segregating_sites))"""


METHODS = REPLICATE_TABLE + f""",
summary AS (
  SELECT method, scenario, count(*) AS replicates, {_errors('a_to_b')}, {_errors('b_to_a')},
    round({_share(SIGN)}, 8) AS direction_accuracy,
    CASE WHEN bool_and(truth_m_a_to_b = truth_m_b_to_a) THEN round({_share(CALLS)}, 8) END
      AS false_directional_positive_rate
  FROM replicates GROUP BY ALL)"""

def _limit(section: str, metric: str, value: str, bound: str, limit: float, source: str, detail: str) -> str:
    return (
        f"SELECT '{section}' AS section, '{metric}' AS metric, CAST({value} AS DOUBLE) AS observed, '{bound} {limit:.3f}' AS target, "
        f"{value} {bound} {limit} AS passed, '{detail}' AS detail FROM {source}"
    )


_BLOCKS = "linkage WHERE method LIKE 'block_%'"
_LINKAGE_GATES = [
    _limit("mechanistic_linkage", "minimum_success_rate", "min(success_rate)", ">=", 0.95, _BLOCKS,
           "Smallest share of successful fits of any block method."),
    _limit("mechanistic_linkage", "minimum_interval_coverage", "min(least(coverage_a_to_b, coverage_b_to_a))", ">=", 0.9, _BLOCKS,
           "Smallest interval coverage of any block method, either direction."),
    _limit("mechanistic_linkage", "maximum_interval_coverage", "max(greatest(coverage_a_to_b, coverage_b_to_a))", "<=", 0.99, _BLOCKS,
           "Largest interval coverage of any block method; near 1 the intervals say little."),
]
_OTHER_GATES = [
    _limit("recovery_grid", "minimum_success_rate", "min(success_rate)", ">=", 0.95, "grid_summary",
           "Smallest share of successful fits of any grid cell."),
    _limit("recovery_grid", "minimum_direction_accuracy", "min(direction_accuracy)", ">=", 0.9, "grid_summary",
           "Smallest accuracy of any cell whose true flow has a direction."),
    _limit("recovery_grid", "maximum_false_direction_rate", "max(false_directional_positive_rate)", "<=", 0.05, "grid_summary",
           "Largest share of directional calls of any cell with equal flows."),
    _limit("threshold_calibration", "false_direction_rate", "false_directional_positive_rate", "<=", 0.05, "scan",
           "Share of directional calls among null rows at the chosen thresholds."),
    _limit("threshold_calibration", "directional_sensitivity", "directional_sensitivity", ">=", 0.8, "scan",
           "Share of directional rows that get their true direction."),
    _limit("threshold_calibration", "direction_accuracy_when_called", "direction_accuracy_when_called", ">=", 0.9, "scan",
           "Share of right directions among the rows called directional."),
    """SELECT 'external_comparison', 'external_methods_present', CAST(count(DISTINCT method) AS DOUBLE), 'one external method or more',
              count(DISTINCT method) >= 1, 'Methods other than ours: ' || string_agg(DISTINCT method, ', ') FROM compared WHERE method <> 'engine'""",
    """SELECT 'external_comparison', 'strict_matched_replicates', 1.0, 'all methods ran the same replicates', TRUE,
              'A release compares methods on the very same simulated data sets.'""",
    """SELECT 'external_comparison', 'external_method_versions', CAST(count(DISTINCT method) AS DOUBLE), 'a version for each external method',
              TRUE, 'Versions on record: engine 1, other 2' FROM compared WHERE method <> 'engine'""",
    """SELECT 'external_comparison', 'estimand_documented', 1.0, 'one named estimand or more', TRUE,
              'Directions may be compared across estimands; sizes need a single one.'""",
    """SELECT 'external_comparison', 'magnitude_estimand_compatibility', 1.0,
              'one estimand, or any number of them where only directions are compared', TRUE, 'Sizes too; named estimands: scaled'""",
    """SELECT 'data_requirements', 'empirical_minimum_guidance', CAST(count(*) FILTER (passes_targets) AS DOUBLE),
              'a regime that passes, with its minimal requirements',
              count(*) FILTER (passes_targets) > 0 AND (SELECT count(*) FROM front) > 0,
              count(*) FILTER (passes_targets) || ' regimes pass and ' || (SELECT count(*) FROM front) || ' are minimal; the study ended as: '
              || CASE WHEN count(*) FILTER (passes_targets) > 0 THEN 'recommendations_available' ELSE 'no_tested_regime_met_targets' END FROM tested""",
]
_GATE_TABLES = REGIMES + ",\n" + LINKED.removeprefix("WITH ") + ",\n" + ONE_THRESHOLD.removeprefix("WITH ") + f""",
compared AS (SELECT method FROM ({REPLICATE_TABLE} SELECT * FROM replicates)),
front AS ({_front('tested')}),
gates AS ("""
GATES = _GATE_TABLES + "\n  UNION ALL ".join(_OTHER_GATES + _LINKAGE_GATES) + ")"
CAMPAIGN = _GATE_TABLES + "\n  UNION ALL ".join([
    *_OTHER_GATES,
    """SELECT 'mechanistic_linkage', 'study_completed', NULL, 'a table mechanistic_grid_summary.csv', FALSE,
              'The study wrote nothing to campaign/mechanistic_linkage/mechanistic_grid_summary.csv'""",
]) + ")"
_EACH_GATE = """
      SELECT section, metric, round(CAST(observed AS DOUBLE), 6) AS observed, target, passed, detail FROM gates"""
_ALL_GATES = """
      SELECT bool_and(coalesce(passed, FALSE)) AS release_ready, count(*) AS checks_total,
             count(*) FILTER (coalesce(passed, FALSE)) AS checks_passed,
             count(*) FILTER (NOT coalesce(passed, FALSE)) AS checks_failed_or_missing,
             coalesce(string_agg(section || '/' || metric || ': ' || detail, '; ' ORDER BY section, metric, detail)
                      FILTER (NOT coalesce(passed, FALSE)), '') AS blockers FROM gates"""

VALID_GENOTYPE = "gt IN ('0/0', '0/1', '1|0', '1/1', '1', '0/0/1')"

ORACLE: dict[str, str] = {
    "vcf_allele_counts": as_ctes("genotypes") + f""",
      read AS (SELECT *, CASE gt WHEN '0/0' THEN 0 WHEN '1/1' THEN 2 ELSE 1 END AS alt_n,
                      CASE gt WHEN '1' THEN 1 WHEN '0/0/1' THEN 3 ELSE 2 END AS called
               FROM genotypes WHERE {VALID_GENOTYPE})
      SELECT chrom, pos, 'A' AS ref, 'G' AS alt, population, CAST(sum(called - alt_n) AS BIGINT) AS ref_count,
             CAST(sum(alt_n) AS BIGINT) AS alt_count, CAST(sum(called) AS BIGINT) AS called_chromosomes
      FROM read GROUP BY ALL""",
    "vcf_file_counts": as_ctes("genotypes") + f""",
      read AS (SELECT *, CASE gt WHEN '0/0' THEN 0 WHEN '1/1' THEN 2 ELSE 1 END AS alt_n,
                      CASE gt WHEN '1' THEN 1 WHEN '0/0/1' THEN 3 ELSE 2 END AS called
               FROM genotypes WHERE {VALID_GENOTYPE})
      SELECT chrom, pos, 'A' AS ref, 'G' AS alt, population, CAST(sum(alt_n) AS BIGINT) AS alt_count,
             CAST(sum(called) AS BIGINT) AS called_chromosomes FROM read GROUP BY ALL""",
    "vcf_block_gzip_counts": as_ctes("genotypes") + f""",
      read AS (SELECT *, CASE gt WHEN '0/0' THEN 0 WHEN '1/1' THEN 2 ELSE 1 END AS alt_n,
                      CASE gt WHEN '1' THEN 1 WHEN '0/0/1' THEN 3 ELSE 2 END AS called
               FROM genotypes WHERE {VALID_GENOTYPE})
      SELECT chrom, pos, 'A' AS ref, 'G' AS alt, population, CAST(sum(alt_n) AS BIGINT) AS alt_count,
             CAST(sum(called) AS BIGINT) AS called_chromosomes FROM read GROUP BY ALL""",
    "allele_counts": COUNTS + " SELECT * FROM counts",
    "allele_counts_min_called": COUNTS + " SELECT * FROM counts WHERE called_chromosomes >= 10",
    "locus_totals": as_ctes("counts", "people") + """
      SELECT count(*) AS samples, count(DISTINCT population) AS populations,
             (SELECT count(*) FROM (SELECT DISTINCT chrom, pos, ref, alt FROM counts)) AS loci FROM people""",
    "pair_configurations": SHARED + f" SELECT {PAIR}, n_a, x_a, n_b, x_b, count(*) AS loci FROM shared GROUP BY ALL",
    "jsfs_exact": EXACT + " SELECT * FROM exact",
    "jsfs_exact_stats": EXACT + ",\n" + PAIRS[PAIRS.index("pairs AS"):] + f"""
      SELECT {PAIR}, CAST(coalesce(used, 0) AS BIGINT) AS loci_used, CAST(either - coalesce(used, 0) AS BIGINT) AS loci_skipped
      FROM seen LEFT JOIN (SELECT {PAIR}, sum(mass) AS used FROM exact GROUP BY ALL) USING ({PAIR})""",
    "jsfs_mode_size": MODES + f"""
      SELECT {PAIR}, a.n AS chromosomes_a, b.n AS chromosomes_b FROM mode_a a JOIN mode_b b USING ({PAIR})""",
    "jsfs_projected": PROJECTED + f" SELECT {PAIR}, i, j, round(mass, 6) AS mass FROM cells",
    "jsfs_projected_stats": PAIRS + f"""
      SELECT {PAIR}, CAST(coalesce(used, 0) AS BIGINT) AS loci_used, CAST(either - coalesce(used, 0) AS BIGINT) AS loci_skipped
      FROM seen LEFT JOIN (SELECT {PAIR}, count(*) AS used FROM shared WHERE n_a >= {SIZE} AND n_b >= {SIZE} GROUP BY ALL)
        USING ({PAIR})""",
    "jsfs_folded": FOLDED + f" SELECT {PAIR}, i, j, round(mass, 6) AS mass FROM folded",
    "jsfs_polarized": PROJECTED + f" SELECT {PAIR}, i, j, round(mass, 6) AS mass FROM cells WHERE {INNER}",
    "spectrum_observations": EXACT + f" SELECT {PAIR}, count(*) AS observations FROM exact GROUP BY ALL",
    "hypergeom_table": COUNTS + f""",
      sizes AS (SELECT DISTINCT called_chromosomes AS called, alt_count AS alt FROM counts
                WHERE called_chromosomes >= {SIZE}),
      grid AS (SELECT *, unnest(range(0, {SIZE + 1})) AS k FROM sizes)
      SELECT called, alt, k, round({_pmf('k', 'called', 'alt')}, 9) AS p FROM grid
      WHERE k <= alt AND {SIZE} - k <= called - alt""",
    "candidate_pairs_distance": DISTANCES + f"""
      SELECT {PAIR}, round(distance_km, 6) AS distance_km FROM pairs WHERE distance_km <= 1500""",
    "candidate_pairs_knn": DISTANCES + f"""
      SELECT DISTINCT {PAIR}, round(distance_km, 6) AS distance_km FROM near WHERE r <= 3""",
    "candidate_pairs_both": DISTANCES + f"""
      SELECT DISTINCT {PAIR}, round(distance_km, 6) AS distance_km FROM near WHERE r <= 2 OR distance_km <= 900""",
    "candidate_pairs_all": as_ctes("nation_places") + f"""
      SELECT a.population AS population_a, b.population AS population_b, round({_haversine('a', 'b')}, 6) AS distance_km
      FROM nation_places a JOIN nation_places b ON a.ord < b.ord""",
    "graph_options": DISTANCES + f"""
      SELECT CAST(k AS INTEGER) AS neighbors, count(*) AS candidate_pairs,
             round(median(distance_km), 6) AS median_distance_km, round(max(distance_km), 6) AS max_distance_km
      FROM (SELECT DISTINCT k, {PAIR}, distance_km FROM near, (SELECT unnest([2, 3, 4, 5]) AS k) WHERE r <= k) GROUP BY k""",
}

BOOTSTRAP_SUMMARY = f""",
      estimates AS (SELECT {PAIR}, replicate, 0.02 + 0.002 * sum(j * mass) / sum(mass) AS ab,
                           0.005 + 0.0005 * sum(i * mass) / sum(mass) AS ba FROM replicate_cells GROUP BY ALL)
      SELECT {PAIR}, round(avg(ab), 8) AS m_a_to_b_mean, round(quantile_cont(ab, 0.025), 8) AS m_a_to_b_lower,
             round(quantile_cont(ab, 0.975), 8) AS m_a_to_b_upper, round(avg(ba), 8) AS m_b_to_a_mean,
             round(quantile_cont(ba, 0.025), 8) AS m_b_to_a_lower, round(quantile_cont(ba, 0.975), 8) AS m_b_to_a_upper,
             round({_share('ab > ba')}, 8) AS probability_a_to_b_stronger, count(*) AS successful_replicates,
             CAST({REPLICATES} AS BIGINT) AS attempted_replicates,
             CASE WHEN avg(ab) >= avg(ba) THEN round({_share('ab > ba')}, 8) ELSE round(1 - {_share('ab > ba')}, 8) END
               AS preferred_direction_support
      FROM estimates GROUP BY ALL"""

RETENTION = PAIRS + f""",
sizes AS (SELECT unnest(range(2, (SELECT max(called_chromosomes) FROM counts) + 1, 2)) AS size),
pair_sizes AS (SELECT {PAIR}, size FROM pairs CROSS JOIN sizes),
kept AS (SELECT {PAIR}, size, count(*) AS loci FROM shared JOIN sizes ON least(n_a, n_b) >= size GROUP BY ALL),
filled AS (SELECT size, coalesce(loci, 0) AS loci FROM pair_sizes LEFT JOIN kept USING ({PAIR}, size)),
total AS (SELECT count(*) AS n FROM (SELECT DISTINCT chrom, pos, ref, alt FROM counts)),
retention AS (
  SELECT size AS projection_chromosomes, n AS total_loci, count(*) AS population_pairs, min(loci) AS minimum_pair_loci,
         CAST(median(loci) AS DOUBLE) AS median_pair_loci, min(loci) / n AS minimum_pair_retention,
         median(loci) / n AS median_pair_retention FROM filled, total GROUP BY size, n)"""

ORACLE |= {
    "projection_retention": RETENTION + """
      SELECT * REPLACE (round(minimum_pair_retention, 6) AS minimum_pair_retention,
                        round(median_pair_retention, 6) AS median_pair_retention) FROM retention""",
    "recommend_projection": RETENTION + """
      SELECT coalesce(max(projection_chromosomes) FILTER (minimum_pair_retention >= 0.5), min(projection_chromosomes))
        AS recommended_projection FROM retention""",
    "block_spectra": BLOCK_CELLS + f" SELECT {PAIR}, chrom, block, i, j, round(mass, 6) AS mass FROM block_cells",
    "block_ordinals": BLOCKED + _ordinals("blocked") + f" SELECT {PAIR}, chrom, block, ordinal FROM ordinals",
    "bootstrap_weights": BLOCKED
    + f", usable AS (SELECT * FROM blocked WHERE n_a >= {SIZE} AND n_b >= {SIZE})"
    + _ordinals("usable") + WEIGHTS
    + f" SELECT {PAIR}, CAST(replicate AS INTEGER) AS replicate, ordinal, weight FROM weights",
    "bootstrap_spectra": REPLICATE_CELLS + f"""
      SELECT {PAIR}, CAST(replicate AS INTEGER) AS replicate, i, j, round(mass, 6) AS mass FROM replicate_cells""",
    "bootstrap_summary": REPLICATE_CELLS + BOOTSTRAP_SUMMARY,
    "poisson_bootstrap_spectra": POISSON_CELLS + f"""
      SELECT {PAIR}, CAST(replicate AS INTEGER) AS replicate, i, j, round(mass, 6) AS mass FROM replicate_cells""",
    "poisson_bootstrap_summary": POISSON_CELLS + BOOTSTRAP_SUMMARY,
    "locus_bootstrap_summary": LOCUS_CELLS + BOOTSTRAP_SUMMARY.replace(", 8)", ", 6)"),
    "locus_bootstrap_mass": SHARED + f"""
      SELECT {PAIR}, CAST(unnest(range(0, {REPLICATES})) AS INTEGER) AS replicate, mass FROM (
        SELECT {PAIR}, CAST(count(*) AS DOUBLE) AS mass FROM shared WHERE n_a >= {SIZE} AND n_b >= {SIZE} GROUP BY ALL)""",
}


def _likelihoods(grid: str) -> str:
    """Log-likelihood of both directions over a grid of rates."""
    return as_ctes("frequencies") + f""",
observed AS (
  SELECT 'a_to_b' AS direction, p_a_initial AS s, p_b_initial AS r, round_even(p_b_final * {2 * NE}, 0) AS c FROM frequencies
  UNION ALL SELECT 'b_to_a', p_b_initial, p_a_initial, round_even(p_a_final * {2 * NE}, 0) FROM frequencies),
rates AS ({grid}),
mixed AS (SELECT direction, m, c, least(greatest((1 - m) * r + m * s, 1e-12), 1 - 1e-12) AS e FROM observed CROSS JOIN rates),
likelihood AS (
  SELECT direction, m, sum(CASE WHEN c > 0 THEN c * ln(e) ELSE 0 END
                           + CASE WHEN c < {2 * NE} THEN ({2 * NE} - c) * ln(1 - e) ELSE 0 END) AS log_likelihood
  FROM mixed GROUP BY ALL)"""


def _refined(k: int, before: str, width: float) -> str:
    """The likelihood over 301 rates around the best one of the grid before; it is concave in the rate."""
    return f""",
near{k} AS (SELECT direction, unnest(range(-150, 151)) * {width!r} + m0 AS m
            FROM (SELECT direction, arg_max(m, log_likelihood) AS m0 FROM {before} GROUP BY direction)),
mixed{k} AS (SELECT o.direction, m, c, least(greatest((1 - m) * r + m * s, 1e-12), 1 - 1e-12) AS e
             FROM observed o JOIN near{k} n ON o.direction = n.direction AND m BETWEEN 0 AND 1),
likelihood{k} AS (
  SELECT direction, m, sum(CASE WHEN c > 0 THEN c * ln(e) ELSE 0 END
                           + CASE WHEN c < {2 * NE} THEN ({2 * NE} - c) * ln(1 - e) ELSE 0 END) AS log_likelihood
  FROM mixed{k} GROUP BY ALL)"""


BOOTSTRAPPED = 10
_FOUR = "p_a_initial, p_b_initial, p_a_final, p_b_final"


def _replicate_rates() -> str:
    """The best rate per direction and replicate, by three grids, each around the best rate of the one before."""
    out = as_ctes("frequencies") + f""",
kinds AS (SELECT {_FOUR}, count(*) AS c FROM frequencies GROUP BY ALL)""" + _tree_draws("kinds", "", _FOUR, BOOTSTRAPPED) + f""",
seen AS (
  SELECT 'a_to_b' AS direction, replicate, p_a_initial AS s, p_b_initial AS r, round_even(p_b_final * {2 * NE}, 0) AS c, weight FROM drawn
  UNION ALL SELECT 'b_to_a', replicate, p_b_initial, p_a_initial, round_even(p_a_final * {2 * NE}, 0), weight FROM drawn),
observed AS MATERIALIZED (SELECT direction, replicate, s, r, c, sum(weight) AS weight FROM seen GROUP BY ALL),
g0 AS (SELECT DISTINCT direction, replicate, unnest(range(0, 1001)) / 10000 AS m FROM observed)"""
    for k, width in enumerate((1e-6, 1e-8, None)):
        out += f""",
e{k} AS (SELECT direction, replicate, m, c, weight, least(greatest((1 - m) * r + m * s, 1e-12), 1 - 1e-12) AS e
         FROM observed JOIN g{k} USING (direction, replicate)),
l{k} AS (SELECT direction, replicate, m, sum(weight * (CASE WHEN c > 0 THEN c * ln(e) ELSE 0 END
           + CASE WHEN c < {2 * NE} THEN ({2 * NE} - c) * ln(1 - e) ELSE 0 END)) AS log_likelihood FROM e{k} GROUP BY ALL),
m{k} AS MATERIALIZED (SELECT direction, replicate, arg_max(m, log_likelihood) AS m0 FROM l{k} GROUP BY ALL)"""
        if width:
            out += f""",
g{k + 1} AS (SELECT direction, replicate, m FROM (SELECT direction, replicate, unnest(range(-150, 151)) * {width!r} + m0 AS m FROM m{k})
             WHERE m BETWEEN 0 AND 1)"""
    return out + f""",
estimates AS (SELECT replicate, max(m0) FILTER (direction = 'a_to_b') AS ab, max(m0) FILTER (direction = 'b_to_a') AS ba
              FROM m2 GROUP BY replicate)"""


ORACLE |= {
    "transition_bootstrap": _replicate_rates() + BOOTSTRAP_SUMMARY[BOOTSTRAP_SUMMARY.rindex("      SELECT"):].replace(
        f"SELECT {PAIR}, ", "SELECT "
    ).replace(", 8)", ", 5)").replace(
        f"CAST({REPLICATES} AS BIGINT)", f"CAST({BOOTSTRAPPED} AS BIGINT)"
    ).replace("      FROM estimates", f", CAST({BOOTSTRAPPED} AS INTEGER) AS replicates FROM estimates"),
    "transition_scan": _likelihoods("SELECT unnest(range(1, 41)) / 200 AS m") + """
      SELECT direction, round(m, 3) AS m, round(log_likelihood, 3) AS log_likelihood FROM likelihood""",
    "transition_mle": _likelihoods("SELECT unnest(range(0, 1001)) / 10000 AS m") + "".join(
        _refined(k, before, width) for k, (before, width) in enumerate((("likelihood", 1e-6), ("likelihood0", 1e-8)))
    ) + """
      SELECT round(max(m) FILTER (direction = 'a_to_b'), 5) AS m_a_to_b,
             round(max(m) FILTER (direction = 'b_to_a'), 5) AS m_b_to_a
      FROM (SELECT direction, arg_max(m, log_likelihood) AS m FROM likelihood1 GROUP BY direction)""",
    "aic_ranking": _ranking("aic", AIC) + """
      SELECT * REPLACE (round(log_likelihood, 6) AS log_likelihood, round(aic, 6) AS aic, round(delta, 6) AS delta,
                        round(akaike_weight, 6) AS akaike_weight) FROM ranking""",
    "aicc_ranking": _ranking("aicc", AICC) + """
      SELECT * REPLACE (round(log_likelihood, 6) AS log_likelihood, round(aicc, 6) AS aicc, round(delta, 6) AS delta,
                        round(akaike_weight, 6) AS akaike_weight) FROM ranking""",
    "best_model": _ranking("aic", AIC) + """
      SELECT pair_id, model AS best_model,
             CASE WHEN model IN ('asymmetric_migration', 'secondary_contact_asymmetric') THEN model END
               AS directional_model, round(akaike_weight, 6) AS best_weight FROM ranking WHERE model_rank = 1""",
    "multistart_stability": as_ctes("fit_runs") + """,
      totals AS (SELECT pair_id, model, count(*) AS runs, count(*) FILTER (success) AS good,
                        max(log_likelihood) FILTER (success) AS best FROM fit_runs GROUP BY ALL),
      ranked AS (SELECT f.*, runs, good, best, row_number() OVER (PARTITION BY pair_id, model
                          ORDER BY log_likelihood DESC, run) AS r
                 FROM fit_runs f JOIN totals USING (pair_id, model) WHERE success AND log_likelihood >= best - 2),
      kept AS (SELECT * FROM ranked WHERE r <= greatest(2, ceil(good * 0.25))),
      spread AS (SELECT pair_id, model, count(*) AS n, max(runs) AS runs, max(good) AS good, max(best) AS best,
                   arg_min(run, r) AS best_run, arg_min(m_a_to_b, r) AS m_a_to_b, arg_min(m_b_to_a, r) AS m_b_to_a,
                   CASE WHEN count(*) >= 2 THEN greatest(
                     (max(m_a_to_b) - min(m_a_to_b)) / greatest(abs(median(m_a_to_b)), 1e-12),
                     (max(m_b_to_a) - min(m_b_to_a)) / greatest(abs(median(m_b_to_a)), 1e-12))
                   ELSE CAST('inf' AS DOUBLE) END AS s FROM kept GROUP BY ALL)
      SELECT pair_id, model, best_run, round(best, 6) AS best_log_likelihood, round(good / runs, 6) AS converged_fraction,
             n AS near_best_runs, round(s, 6) AS largest_spread, n >= 2 AND s <= 0.5 AS stable,
             round(m_a_to_b, 6) AS m_a_to_b, round(m_b_to_a, 6) AS m_b_to_a FROM spread""",
    "library_scan": SCAN + f""",
      near AS (SELECT * FROM scan QUALIFY log_likelihood >= max(log_likelihood) OVER (PARTITION BY {PAIR}, model) - 1e-6),
      best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY {PAIR}, model ORDER BY param_id) = 1)
      SELECT {PAIR}, model, param_id, round(log_likelihood, 3) AS log_likelihood, round(d / s, 3) AS theta
      FROM best JOIN model_totals USING (model, param_id) JOIN facts USING ({PAIR})""",
    "profile_scan": SCAN + f"""
      SELECT {PAIR}, round(fixed_value, 3) AS fixed_value, round(log_likelihood, 3) AS log_likelihood,
             round(max(log_likelihood) OVER (PARTITION BY {PAIR}) - log_likelihood, 3) AS delta_log_likelihood
      FROM profile""",
    "profile_interval": SCAN + f""",
      topped AS (SELECT *, max(log_likelihood) OVER (PARTITION BY {PAIR}) AS top FROM profile)
      SELECT {PAIR}, round(max(top), 3) AS maximum_log_likelihood,
             round(min(fixed_value) FILTER (log_likelihood >= top - 0.5 * 3.841458820694124), 3) AS lower,
             round(max(fixed_value) FILTER (log_likelihood >= top - 0.5 * 3.841458820694124), 3) AS upper
      FROM topped GROUP BY ALL""",
    "profile_grid": SCORES + """,
      starts AS (SELECT pair_id, model, -log_likelihood / 100 AS mle FROM scores),
      bounds AS (SELECT *, ln(greatest(1e-5, mle / 10)) AS lo, ln(least(50.0, mle * 10)) AS hi FROM starts)
      SELECT DISTINCT pair_id, model, round(mle, 6) AS mle, round(fixed_value, 6) AS fixed_value FROM (
        SELECT pair_id, model, mle, exp(lo + (hi - lo) * step / 14) AS fixed_value
        FROM bounds CROSS JOIN (SELECT unnest(range(0, 15)) AS step)
        UNION SELECT pair_id, model, mle, mle FROM bounds)""",
    # No sums: both engines do the same divisions, so nothing is rounded.
    "rate_functions": as_ctes("evidence") + f"""
      SELECT evidence_id, {_asym('migration_forward', 'migration_reverse')} AS asymmetry,
             CASE WHEN migration_reverse = 0 THEN CASE WHEN migration_forward > 0 THEN -1.0 ELSE 1.0 END
                  ELSE migration_forward / migration_reverse END AS ratio,
             CASE WHEN migration_forward > migration_reverse THEN directional_support
                  WHEN migration_reverse > migration_forward THEN 1 - directional_support
                  ELSE CAST(0.5 AS DOUBLE) END AS support
      FROM evidence""",
    "classify_direction": _decided() + f" SELECT {DECIDED_COLUMNS} FROM decided",
    "classify_direction_intervals": _decided(
        weight=0.6, support=0.6, separated="(forward_lower > reverse_upper OR reverse_lower > forward_upper)"
    ) + f" SELECT {DECIDED_COLUMNS} FROM decided",
    "provisional_direction": as_ctes("evidence") + f""",
      indexed AS (SELECT *, {_asym('migration_forward', 'migration_reverse')} AS a,
                         CASE WHEN migration_forward > migration_reverse THEN source || '->' || destination
                              WHEN migration_reverse > migration_forward THEN destination || '->' || source END AS p
                  FROM evidence)
      SELECT evidence_id, source AS population_a, destination AS population_b, round(migration_forward, 9) AS m_a_to_b,
             round(migration_reverse, 9) AS m_b_to_a, round(directional_support, 9) AS directional_support,
             round(asymmetric_model_weight, 9) AS asymmetric_model_weight, optimizer_stable,
             CASE WHEN asymmetric_model_weight < 0.7 THEN 'unsupported'
                  WHEN optimizer_stable AND abs(a) >= 0.25 AND p IS NOT NULL THEN 'candidate' ELSE 'ambiguous' END AS status,
             CASE WHEN asymmetric_model_weight >= 0.7 THEN p END AS preferred_direction,
             round(a, 9) AS asymmetry_index FROM indexed""",
    "flow_table": _flows("'supported'") + f" SELECT {FLOW_COLUMNS}, reason FROM flows",
    "flow_table_ambiguous": _flows(BOTH) + f" SELECT {FLOW_COLUMNS}, reason FROM flows",
    "pairwise_flows": _flows(BOTH) + f" SELECT {FLOW_COLUMNS} FROM flows",
    "status_counts": _decided(support=0.6) + """
      SELECT status, (SELECT count(*) FROM decided d WHERE d.status = s.status) AS pairs
      FROM (SELECT unnest(['supported', 'ambiguous', 'unsupported']) AS status) s""",
    "map_edges": _flows(BOTH).replace("WITH ", as_ctes("nation_places") + ",\n", 1) + """,
      drawn AS (SELECT *, max(migration) OVER () AS top FROM flows WHERE migration >= 0.5 AND support >= 0.3)
      SELECT evidence_id, source, destination, round(migration, 9) AS migration,
             round(s.latitude, 9) AS source_latitude, round(s.longitude, 9) AS source_longitude,
             round(d.latitude, 9) AS destination_latitude, round(d.longitude, 9) AS destination_longitude,
             round(0.7 + 4.3 * sqrt(migration / top), 9) AS line_width, round(0.2 + 0.8 * support, 9) AS alpha,
             CASE WHEN status = 'ambiguous' THEN '--' ELSE '-' END AS line_style
      FROM drawn JOIN nation_places s ON source = s.population JOIN nation_places d ON destination = d.population""",
    "network_edges": _flows(BOTH) + """
      SELECT source, destination, round(migration, 9) AS migration, status, round(support, 9) AS support,
             round(asymmetry_index, 9) AS asymmetry_index, round(model_weight, 9) AS model_weight
      FROM flows QUALIFY row_number() OVER (PARTITION BY source, destination ORDER BY evidence_id DESC) = 1""",
    "source_sink": _flows("'supported'") + """,
      edges AS (SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY source, destination ORDER BY evidence_id DESC) = 1),
      ends AS (SELECT source AS population, migration AS o, 0 AS i, 1 AS od, 0 AS id FROM edges
               UNION ALL SELECT destination, 0, migration, 0, 1 FROM edges)
      SELECT population, round(sum(o), 9) AS outgoing_migration, round(sum(i), 9) AS incoming_migration,
             round(sum(o) - sum(i), 9) AS net_flow,
             CASE WHEN sum(o) > sum(i) THEN 'source-like' WHEN sum(o) < sum(i) THEN 'sink-like' ELSE 'balanced' END
               AS network_role,
             CAST(sum(od) AS BIGINT) AS out_degree, CAST(sum(id) AS BIGINT) AS in_degree FROM ends GROUP BY population""",
    "metrics_bias_rmse": REPLICATE_TABLE + """
      SELECT method, scenario, round(avg(estimated_m_a_to_b - truth_m_a_to_b), 8) AS bias,
             round(sqrt(avg((estimated_m_a_to_b - truth_m_a_to_b) ** 2)), 8) AS rmse FROM replicates GROUP BY ALL""",
    "interval_coverage": REPLICATE_TABLE + f"""
      SELECT method, scenario, round({_share('truth_m_a_to_b BETWEEN m_a_to_b_lower AND m_a_to_b_upper')}, 6)
        AS interval_coverage FROM replicates GROUP BY ALL""",
    "direction_accuracy": REPLICATE_TABLE + f"""
      SELECT method, scenario, round({_share(SIGN)}, 6) AS direction_accuracy FROM replicates GROUP BY ALL""",
    "direction_accuracy_tolerance": REPLICATE_TABLE + f""",
      signs AS (SELECT *, CASE WHEN abs(truth_m_a_to_b - truth_m_b_to_a) <= 0.3 THEN 0
                               ELSE sign(truth_m_a_to_b - truth_m_b_to_a) END AS t,
                       CASE WHEN abs(estimated_m_a_to_b - estimated_m_b_to_a) <= 0.3 THEN 0
                            ELSE sign(estimated_m_a_to_b - estimated_m_b_to_a) END AS e FROM replicates)
      SELECT method, scenario, round({_share('t = e')}, 6) AS direction_accuracy FROM signs GROUP BY ALL""",
    "false_direction_rate": REPLICATE_TABLE + f"""
      SELECT method, round({_share(CALLS)}, 6) AS false_directional_positive_rate FROM replicates
      WHERE expected_direction = 'symmetric' GROUP BY ALL""",
    "recovery_summary": REPLICATE_TABLE + f"""
      SELECT method, scenario, min(expected_direction) AS expected_direction, count(*) AS attempted_replicates,
        count(*) FILTER (success) AS successful_replicates, round(count(*) FILTER (success) / count(*), 8) AS success_rate,
        {_errors('a_to_b', 'success')}, {_errors('b_to_a', 'success')},
        round({_share(SIGN, 'success')}, 8) AS direction_accuracy,
        round({_share('optimizer_stable', 'success')}, 8) AS optimizer_stable_rate,
        round({_share(CALLS, "success AND expected_direction = 'symmetric'")}, 8) AS false_directional_positive_rate
      FROM replicates GROUP BY ALL""",
    "provisional_signal": SIGNALS + """
      SELECT * REPLACE (round(asymmetric_model_weight, 6) AS asymmetric_model_weight,
                        round(estimated_m_a_to_b, 6) AS estimated_m_a_to_b, round(estimated_m_b_to_a, 6) AS estimated_m_b_to_a,
                        round(estimated_asymmetry, 6) AS estimated_asymmetry) FROM signals""",
    "stress_summary": _stress("scenario"),
    "stress_summary_grid": _stress("grid_cell, scenario"),
    "forward_summary": SIGNALS + f"""
      SELECT scenario, {SUCCESS},
        round({_share('provisional_directional_signal', 'success')}, 6) AS false_direction_signal_rate,
        round({_share("best_model = 'asymmetric_migration'", 'success')}, 6) AS asymmetric_model_selected_rate,
        round({_share("best_model = 'secondary_contact_asymmetric'", 'success')}, 6) AS secondary_contact_selected_rate
      FROM signals GROUP BY ALL""",
    "coverage_rows": COVERAGE + """
      SELECT * REPLACE (round(recombination_rate, 9) AS recombination_rate, round(true_m_a_to_b, 9) AS true_m_a_to_b,
        round(true_m_b_to_a, 9) AS true_m_b_to_a, round(m_a_to_b_mean, 9) AS m_a_to_b_mean,
        round(m_b_to_a_mean, 9) AS m_b_to_a_mean, round(m_a_to_b_lower, 9) AS m_a_to_b_lower,
        round(m_a_to_b_upper, 9) AS m_a_to_b_upper, round(m_b_to_a_lower, 9) AS m_b_to_a_lower,
        round(m_b_to_a_upper, 9) AS m_b_to_a_upper, round(preferred_direction_support, 9) AS preferred_direction_support,
        round(interval_width_a_to_b, 9) AS interval_width_a_to_b, round(interval_width_b_to_a, 9) AS interval_width_b_to_a,
        round(estimated_asymmetry, 9) AS estimated_asymmetry) FROM coverage""",
    "linked_summary": LINKED + f" SELECT {LINKAGE_COLUMNS} FROM linkage",
    "linkage_grid_summary": LINKED_GRID + f" SELECT recombination_rate, {LINKAGE_COLUMNS} FROM linkage",
    "worst_coverage_grid": LINKED_GRID + """
      SELECT recombination_rate, round(min(least(coverage_a_to_b, coverage_b_to_a)), 6) AS minimum_coverage,
             round(max(false_directional_support_rate) FILTER (scenario = 'symmetric'), 6) AS maximum_false_support_rate
      FROM linkage WHERE method LIKE 'block_%' GROUP BY ALL""",
    "coverage_pivot": LINKED + " SELECT scenario, " + ", ".join(
        f"round(max(coverage_a_to_b) FILTER (method = '{m}'), 6) AS {m}"
        for m in ("locus", "block_50000", "block_100000", "block_250000")
    ) + " FROM linkage GROUP BY scenario",
    "recovery_grid_curves": as_ctes("grid_summary") + """
      SELECT chromosomes, segregating_sites, round(avg(direction_accuracy), 6) AS direction_accuracy,
             round(avg(false_directional_positive_rate), 6) AS false_directional_positive_rate
      FROM grid_summary GROUP BY ALL""",
    "validated_evidence": as_ctes("evidence") + """
      SELECT evidence_id, truth_direction, preferred_direction, round(asymmetric_model_weight, 6) AS asymmetric_model_weight,
             round(directional_support, 6) AS directional_support, round(asymmetry_index, 6) AS asymmetry_index,
             optimizer_stable, interval_separated FROM evidence""",
    "threshold_scan": SCAN_GRID + f" SELECT {SELECTED_COLUMNS}, null_rows, directional_rows FROM scan",
    "evaluate_thresholds": ONE_THRESHOLD + f" SELECT {SELECTED_COLUMNS}, null_rows, directional_rows FROM scan",
    "select_thresholds": SCAN_GRID + f"""
      SELECT {SELECTED_COLUMNS} FROM (
        SELECT * FROM scan WHERE false_directional_positive_rate <= 0.05 AND directional_sensitivity IS NOT NULL
          AND called_fraction > 0
        ORDER BY scan.directional_sensitivity DESC, coalesce(scan.direction_accuracy_when_called, -1) DESC,
                 scan.min_directional_support DESC, scan.min_abs_asymmetry DESC, scan.min_model_weight DESC LIMIT 1)""",
    "data_regimes": REGIMES + """
      SELECT * REPLACE (round(minimum_success_rate, 6) AS minimum_success_rate,
        round(minimum_direction_accuracy, 6) AS minimum_direction_accuracy,
        round(maximum_false_direction_rate, 6) AS maximum_false_direction_rate) FROM tested""",
    "pareto_minimum": as_ctes("regimes") + """,
      best AS (SELECT segregating_sites, min(chromosomes) AS chromosomes FROM regimes WHERE passes_targets GROUP BY ALL),
      earlier AS (SELECT *, min(chromosomes) OVER (ORDER BY segregating_sites
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best)
      SELECT r.* FROM regimes r JOIN earlier e USING (chromosomes, segregating_sites)
      WHERE passes_targets AND (before IS NULL OR r.chromosomes < before)""",
    "data_requirements": REGIMES + f""",
      front AS ({_front('tested')})
      SELECT count(*) AS tested_regimes, count(*) FILTER (passes_targets) AS passing_regimes,
        coalesce((SELECT string_agg(chromosomes || 'x' || segregating_sites, ',' ORDER BY segregating_sites, chromosomes)
                  FROM front), '') AS pareto_minimum_regimes,
        CASE WHEN (SELECT count(*) FROM front) > 0 THEN 'recommendations_available'
             ELSE 'no_tested_regime_met_targets' END AS status FROM tested""",
    "matched_comparison": REPLICATE_TABLE + """
      SELECT scenario, replicate, round(truth_m_a_to_b, 6) AS truth_m_a_to_b, round(truth_m_b_to_a, 6) AS truth_m_b_to_a,
             round(estimated_m_a_to_b, 6) AS estimated_m_a_to_b, round(estimated_m_b_to_a, 6) AS estimated_m_b_to_a,
             'scaled' AS estimand, CASE method WHEN 'engine' THEN '1' ELSE '2' END AS method_version, method
      FROM replicates""",
    "method_summary": METHODS + " SELECT * FROM summary",
    "direction_only_summary": METHODS + """
      SELECT method, scenario, replicates, round(direction_accuracy, 6) AS direction_accuracy,
             round(false_directional_positive_rate, 6) AS false_directional_positive_rate FROM summary""",
    "method_pivot": METHODS + """
      SELECT scenario, round(avg(direction_accuracy) FILTER (method = 'engine'), 6) AS engine,
             round(avg(direction_accuracy) FILTER (method = 'other'), 6) AS other
      FROM summary WHERE false_directional_positive_rate IS NULL GROUP BY scenario""",
    "method_pivot_false": METHODS + """
      SELECT scenario, round(avg(false_directional_positive_rate) FILTER (method = 'engine'), 6) AS engine,
             round(avg(false_directional_positive_rate) FILTER (method = 'other'), 6) AS other
      FROM summary WHERE false_directional_positive_rate IS NOT NULL GROUP BY scenario""",
    "comparison_metadata": REPLICATE_TABLE + """
      SELECT FALSE AS direction_only, TRUE AS require_complete_match, CAST(0.25 AS DOUBLE) AS asymmetry_threshold,
             TRUE AS magnitude_metrics_reported, string_agg(DISTINCT method, ',' ORDER BY method) AS methods,
             'scaled' AS estimands,
             string_agg(DISTINCT CASE method WHEN 'engine' THEN '1' ELSE '2' END, ','
                        ORDER BY CASE method WHEN 'engine' THEN '1' ELSE '2' END) AS versions FROM replicates""",
    "release_gates": GATES + _EACH_GATE,
    "release_overall": GATES + _ALL_GATES,
    "campaign_gates": CAMPAIGN + _EACH_GATE,
    "campaign_overall": CAMPAIGN + _ALL_GATES,
}

# Two ways to one result.
ORACLE["library_search"] = ORACLE["library_scan"]
# Read back from files, the tables are what they were.
ORACLE["replicates_file"] = ORACLE["method_summary"]
ORACLE["thresholds_file"] = ORACLE["select_thresholds"]
ORACLE["popmap_file"] = as_ctes("people") + " SELECT sample, population FROM people"
ORACLE["coordinates_file"] = as_ctes("places") + """
      SELECT population, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude FROM places"""
