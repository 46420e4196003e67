"""Genetic tables derived from the driver's relational tables.

Each view is one statement in the common subset of Spark SQL and DuckDB, so both
engines read the same data. Braces name the tables and views a statement uses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from driftway.session import parts_of

VIEWS: dict[str, str] = {
    # One row per genotype call; the population is the region of the customer.
    "calls": """
        SELECT concat('chr', CAST(l_partkey % 22 + 1 AS STRING)) AS chrom, l_partkey * 997 + 1 AS pos,
               'A' AS ref, 'G' AS alt, o_custkey AS sample, r_name AS population,
               CASE WHEN l_tax = 0.08 THEN NULL
                    ELSE CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END
                       + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END END AS alt_n,
               CASE WHEN l_tax = 0.08 THEN NULL ELSE 2 END AS called
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
             JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "counts": """
        SELECT chrom, pos, ref, alt, population, CAST(sum(called) - sum(alt_n) AS BIGINT) AS ref_count,
               CAST(sum(alt_n) AS BIGINT) AS alt_count, CAST(sum(called) AS BIGINT) AS called_chromosomes
        FROM {calls} GROUP BY chrom, pos, ref, alt, population HAVING sum(called) >= 1""",
    # One genotype text per part and sample; a sample is a market segment of a nation.
    "genotypes": """
        SELECT concat('chr', CAST(l_partkey % 22 + 1 AS STRING)) AS chrom, l_partkey * 997 + 1 AS pos, sample, population,
               CASE WHEN h <= 5 THEN '0/0' WHEN h <= 7 THEN '0/1' WHEN h = 8 THEN '1|0' WHEN h = 9 THEN '1/1'
                    WHEN h = 10 THEN './.' WHEN h = 11 THEN '.' WHEN h = 12 THEN '1' WHEN h = 13 THEN '0/0/1'
                    WHEN h = 14 THEN '0/2' WHEN h = 15 THEN './1' ELSE '.|.' END AS gt
        FROM (SELECT l_partkey, concat(n_name, '_', c_mktsegment) AS sample, r_name AS population,
                     CAST(sum(l_quantity) AS BIGINT) % 17 AS h
              FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
                   JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
              GROUP BY l_partkey, n_name, c_mktsegment, r_name) x""",
    "popmap": """
        SELECT DISTINCT concat(n_name, '_', c_mktsegment) AS sample, r_name AS population
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "people": """
        SELECT CAST(c_custkey AS STRING) AS sample, r_name AS population
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # Every supplier is a population with a place.
    "places": """
        SELECT s_name AS population, -60.0 + CAST(s_suppkey * 7919 % 12007 AS DOUBLE) / 100 AS latitude,
               -170.0 + CAST(s_suppkey * 104729 % 34019 AS DOUBLE) / 100 AS longitude, s_suppkey AS ord FROM {supplier}""",
    # A nation lies at the middle of its customers.
    "nation_places": """
        SELECT n_name AS population,
               round(-60 + 5 * n_nationkey + sum(c_custkey * 37 % 101) / CAST(count(*) AS DOUBLE) / 50, 3) AS latitude,
               round(-170 + (n_nationkey * 53) % 331 + sum(c_custkey * 53 % 97) / CAST(count(*) AS DOUBLE) / 50, 3)
                   AS longitude,
               n_nationkey AS ord
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
    # Optimiser runs: 50 pairs by 5 models.
    "fit_runs": """
        SELECT user_id % 50 AS pair_id,
               CASE event_type WHEN 'click' THEN 'isolation' WHEN 'view' THEN 'symmetric_migration'
                    WHEN 'purchase' THEN 'asymmetric_migration' WHEN 'signup' THEN 'secondary_contact_symmetric'
                    ELSE 'secondary_contact_asymmetric' END AS model,
               CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 4 WHEN 'error' THEN 6 ELSE 5 END AS parameters,
               event_id AS run, event_id % 13 <> 0 AS success, -100.0 - value AS log_likelihood,
               0.1 + value / 100 AS m_a_to_b, 0.1 + (event_id % 97) / 50 AS m_b_to_a, 40 + user_id % 50 AS observations
        FROM {events}""",
    # Direction evidence, one row per order, between the customer's nation and another one.
    "evidence": """
        SELECT o_orderkey AS evidence_id, source, destination, mf AS migration_forward, mr AS migration_reverse,
               (o_orderkey * 7 % 101) / 100.0E0 AS directional_support,
               0.5E0 + (o_orderkey % 51) / 100.0E0 AS asymmetric_model_weight,
               o_orderstatus <> 'P' AS optimizer_stable, mf * 0.8 AS forward_lower, mf * 1.2 AS forward_upper,
               mr * 0.8 AS reverse_lower, mr * 1.2 AS reverse_upper,
               mf * 0.8 > mr * 1.2 OR mr * 0.8 > mf * 1.2 AS interval_separated,
               CASE WHEN mf + mr = 0 THEN 0.0E0 ELSE (mf - mr) / (mf + mr) END AS asymmetry_index,
               CASE WHEN mf > mr THEN 'A->B' WHEN mr > mf THEN 'B->A' ELSE 'symmetric' END AS preferred_direction,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'symmetric' WHEN o_orderpriority LIKE '2%' THEN 'none'
                    WHEN mf >= mr AND o_orderkey % 9 <> 0 THEN 'A->B' ELSE 'B->A' END AS truth_direction
        FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, s.n_name AS source, d.n_name AS destination,
                     CASE WHEN o_orderkey % 40 = 0 THEN 0.0E0 ELSE o_totalprice / 100000 END AS mf,
                     CASE WHEN o_orderkey % 40 = 0 THEN 0.0E0
                          ELSE CAST(o_custkey % 50 AS DOUBLE) / CAST(12.5 AS DOUBLE) END AS mr
              FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} s ON c_nationkey = s.n_nationkey
                   JOIN {nation} d ON (s.n_nationkey + 1 + o_orderkey % 24) % 25 = d.n_nationkey) x""",
    # Allele frequencies before and after a generation; true rates near 0.05 and 0.01.
    "frequencies": """
        SELECT p_partkey AS locus, a AS p_a_initial, b AS p_b_initial,
               least(1.0E0, greatest(0.0E0, 0.99 * a + 0.01 * b + (p_partkey % 7 - 3) / 500.0E0)) AS p_a_final,
               least(1.0E0, greatest(0.0E0, 0.95 * b + 0.05 * a + (p_partkey % 5 - 2) / 500.0E0)) AS p_b_final
        FROM (SELECT p_partkey, (p_partkey * 37 % 1000) / 1000.0E0 AS a, (p_partkey * 91 % 1000) / 1000.0E0 AS b
              FROM {part}) x""",
    # Parameter sets of the spectrum library, one per part and model.
    "library_parameters": """
        SELECT model, p_partkey AS param_id, (p_size + 1) / 10.0E0 AS m_a_to_b, p_retailprice / 1000 AS m_b_to_a
        FROM (SELECT 'symmetric_migration' AS model, p_partkey, p_size, p_retailprice FROM {part}
              UNION ALL SELECT 'asymmetric_migration' AS model, p_partkey, p_size, p_retailprice FROM {part}) x""",
    # Known-truth replicates of two methods.
    "replicates": """
        SELECT method, scenario, expected_direction, replicate, truth_m_a_to_b, truth_m_b_to_a, success, optimizer_stable,
               truth_m_a_to_b * f * k AS estimated_m_a_to_b, truth_m_b_to_a * g AS estimated_m_b_to_a,
               truth_m_a_to_b * f * k * 0.7 AS m_a_to_b_lower, truth_m_a_to_b * f * k * 1.4 AS m_a_to_b_upper,
               truth_m_b_to_a * g * 0.7 AS m_b_to_a_lower, truth_m_b_to_a * g * 1.4 AS m_b_to_a_upper
        FROM (SELECT 'engine' AS method, 1.0E0 AS k, t.* FROM {truths} t
              UNION ALL SELECT 'other' AS method, 0.8E0 AS k, t.* FROM {truths} t) m""",
    "truths": """
        SELECT event_type AS scenario, event_id AS replicate,
               CASE event_type WHEN 'click' THEN 'symmetric' WHEN 'view' THEN 'A->B' WHEN 'purchase' THEN 'B->A'
                    WHEN 'signup' THEN 'A->B' ELSE 'B->A' END AS expected_direction,
               CAST(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 0.25
                    WHEN 'signup' THEN 2.0 ELSE 0.1 END AS DOUBLE) AS truth_m_a_to_b,
               CAST(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 WHEN 'purchase' THEN 1.0
                    WHEN 'signup' THEN 0.1 ELSE 2.0 END AS DOUBLE) AS truth_m_b_to_a,
               event_id % 11 <> 0 AS success, user_id % 4 <> 0 AS optimizer_stable,
               0.5E0 + value / 100 AS f, 0.6E0 + (event_id % 83) / 100.0E0 AS g
        FROM {events}""",
    # Fitted benchmark replicates with their winning model.
    "stress_replicates": """
        SELECT scenario, replicate, expected_direction, success, optimizer_stable AS stable,
               replicate % 9 AS grid_cell, f - 0.2 AS best_weight,
               CASE WHEN replicate % 3 = 0 THEN 'asymmetric_migration' WHEN replicate % 3 = 1
                    THEN 'secondary_contact_asymmetric' ELSE 'isolation' END AS best_model,
               CASE WHEN replicate % 3 = 0 THEN 'asymmetric_migration' WHEN replicate % 3 = 1
                    THEN 'secondary_contact_asymmetric' END AS directional_model,
               CASE WHEN scenario IN ('click', 'view') THEN 'asymmetric_migration' ELSE 'isolation' END
                   AS generating_model,
               truth_m_a_to_b * f AS m_a_to_b, truth_m_b_to_a * g AS m_b_to_a
        FROM {truths}""",
    # Bootstrap intervals under several resampling methods, per grid cell.
    "bootstrap_replicates": """
        SELECT CASE WHEN replicate % 4 = 0 THEN 'locus' WHEN replicate % 4 = 1 THEN 'block_50000'
                    WHEN replicate % 4 = 2 THEN 'block_100000' ELSE 'block_250000' END AS method,
               CASE replicate % 3 WHEN 0 THEN 1.0E-9 WHEN 1 THEN 1.0E-8 ELSE 1.0E-7 END AS recombination_rate,
               CASE expected_direction WHEN 'symmetric' THEN 'symmetric' ELSE scenario END AS scenario,
               expected_direction, replicate, success,
               truth_m_a_to_b / 20000 AS true_m_a_to_b, truth_m_b_to_a / 20000 AS true_m_b_to_a,
               CASE WHEN success THEN truth_m_a_to_b * f END AS m_a_to_b_mean,
               CASE WHEN success THEN truth_m_b_to_a * g END AS m_b_to_a_mean,
               CASE WHEN success THEN truth_m_a_to_b * f * 0.7 END AS m_a_to_b_lower,
               CASE WHEN success THEN truth_m_a_to_b * f * 1.4 END AS m_a_to_b_upper,
               CASE WHEN success THEN truth_m_b_to_a * g * 0.7 END AS m_b_to_a_lower,
               CASE WHEN success THEN truth_m_b_to_a * g * 1.4 END AS m_b_to_a_upper,
               CASE WHEN success THEN (replicate % 21) / 20.0E0 END AS preferred_direction_support
        FROM {truths}""",
    # Recovery-grid summary: 9 regimes by 3 scenarios.
    "grid_summary": """
        SELECT chromosomes, segregating_sites, scenario, scenario AS expected_direction, avg(s) AS success_rate,
               CASE WHEN scenario = 'symmetric' THEN NULL ELSE avg(a) END AS direction_accuracy,
               CASE WHEN scenario = 'symmetric' THEN avg(1 - a) END AS false_directional_positive_rate
        FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 40 END AS chromosomes,
                     CASE l_suppkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 5000 ELSE 20000 END AS segregating_sites,
                     CASE l_returnflag WHEN 'A' THEN 'A->B' WHEN 'R' THEN 'B->A' ELSE 'symmetric' END AS scenario,
                     CAST(CASE WHEN l_quantity <= 49 THEN 1 ELSE 0 END AS DOUBLE) AS s,
                     CAST(CASE WHEN l_discount < 0.1 OR l_linenumber % 3 = 2 THEN 1 ELSE 0 END AS DOUBLE) AS a
              FROM {lineitem}) x
        GROUP BY chromosomes, segregating_sites, scenario""",
    # Pass or fail of many tested regimes.
    "regimes": """
        SELECT l_partkey AS chromosomes, CAST(l_suppkey * 1000 + l_linenumber AS BIGINT) AS segregating_sites,
               max(l_quantity) >= 30 AS passes_targets
        FROM {lineitem} GROUP BY l_partkey, l_suppkey, l_linenumber""",
}

# Footers are read once per table, not once per query.
_SCHEMAS: dict[str, StructType] = {}
_ROWS: dict[str, int] = {}

# Lines of orders that a task joins and counts. Tasks sized by shuffled bytes hold many times that in memory.
_LINES_PER_TASK = 500_000

_NAME = re.compile(r"\{(\w+)\}")


def _uses(name: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(VIEWS[name])))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name not in VIEWS:
        path = f"{sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = spark.read.parquet(path).schema
        return spark.read.schema(_SCHEMAS[path]).parquet(path)
    inputs = {used: frame(spark, sf_dir, used) for used in _uses(name)}
    if "{lineitem} JOIN {orders}" in VIEWS[name]:
        inputs |= _dealt(sf_dir, inputs)
    return spark.sql(VIEWS[name], **inputs)


def _dealt(sf_dir: str, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """lineitem and orders in tasks of bounded size by order; smaller tables are left to the planner."""
    if sf_dir not in _ROWS:
        _ROWS[sf_dir] = inputs["lineitem"].count()
    parts = parts_of(_ROWS[sf_dir], _LINES_PER_TASK)
    if parts <= 4:
        return {}
    keys = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
    return {name: inputs[name].repartition(parts, key) for name, key in keys.items()}


def as_ctes(*names: str) -> str:
    """The views, and those they need, as the WITH clause of a DuckDB statement."""
    ordered: dict[str, None] = {}

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for used in _uses(name):
                visit(used)
            ordered[name] = None

    for name in names:
        visit(name)
    # A view named like another table would be read in its place.
    texts = [f"{name} AS ({_NAME.sub(lambda m: m.group(1), VIEWS[name])})" for name in ordered]
    return "WITH " + ",\n".join(texts)
