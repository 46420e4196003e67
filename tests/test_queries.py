import importlib.util
import os

import pytest

from driftway.plans.oracle import ORACLE
from driftway.plans.queries import QUERIES
from tests.oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.001"
# The whole set runs through tests/oracle_check.py; these touch every stage.
SAMPLE = (
    "vcf_allele_counts", "locus_totals", "jsfs_exact_stats", "jsfs_folded", "candidate_pairs_both", "recommend_projection",
    "bootstrap_summary", "poisson_bootstrap_summary", "transition_mle", "library_search", "vcf_block_gzip_counts", "multistart_stability", "profile_interval", "classify_direction_intervals",
    "map_edges", "source_sink", "recovery_summary", "linkage_grid_summary", "select_thresholds", "pareto_minimum",
    "matched_comparison", "release_gates",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_every_statement_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"file_inventory", "infer_pairs"}


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) == []


def test_entry(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())
