import itertools
import math

import pytest
from pyspark.sql import functions as F

from driftway.functions import rates
from driftway.functions.checks import strict_bool
from driftway.operators import decisions, geography, network

EVIDENCE = (
    "source string, destination string, migration_forward double, migration_reverse double, directional_support double, "
    "asymmetric_model_weight double, optimizer_stable boolean, forward_lower double, forward_upper double, "
    "reverse_lower double, reverse_upper double"
)


def evidence(spark, **changes):
    row = dict(
        source="A", destination="B", migration_forward=1.0, migration_reverse=0.1, directional_support=0.99,
        asymmetric_model_weight=0.9, optimizer_stable=True, forward_lower=0.8, forward_upper=1.2, reverse_lower=0.05,
        reverse_upper=0.2,
    )
    return spark.createDataFrame([tuple({**row, **changes}.values())], EVIDENCE)


@pytest.mark.parametrize(
    "changes, interval, status, preferred, reason",
    [
        ({}, True, "supported", "A->B", decisions.ALL_MET),
        ({"migration_forward": 0.1, "migration_reverse": 1.0}, False, "supported", "B->A", decisions.ALL_MET),
        ({"migration_forward": 0.0, "migration_reverse": 0.0}, False, "unsupported", None, decisions.NO_SIGNAL),
        ({"asymmetric_model_weight": 0.69}, False, "unsupported", "A->B", decisions.WEAK_MODEL),
        ({"forward_lower": 0.2}, True, "ambiguous", "A->B", decisions.OVERLAP),
        ({"forward_lower": None}, True, "ambiguous", "A->B", decisions.OVERLAP),
        ({"forward_lower": None}, False, "supported", "A->B", decisions.ALL_MET),
        (
            {"optimizer_stable": False, "directional_support": 0.5, "migration_reverse": 0.9}, False, "ambiguous", "A->B",
            "optimizer instability; directional support below threshold; asymmetry below threshold",
        ),
        ({"migration_reverse": 1.0}, False, "ambiguous", None, "asymmetry below threshold"),
    ],
)
def test_classify(spark, changes, interval, status, preferred, reason):
    row = decisions.classify_direction(evidence(spark, **changes), require_interval_separation=interval).first()
    assert (row["status"], row["preferred_direction"], row["reason"]) == (status, preferred, reason)


@pytest.mark.parametrize(
    "changes, message",
    [
        ({"migration_forward": -1.0}, "migration_forward has a value"),
        ({"migration_reverse": math.inf}, "migration_reverse has a value"),
        ({"migration_reverse": math.nan}, "migration_reverse has a value"),
        ({"directional_support": 1.1}, "directional_support is outside"),
        ({"asymmetric_model_weight": None}, "asymmetric_model_weight is outside"),
        ({"forward_lower": 2.0}, "an interval ends below its start"),
        ({"reverse_lower": -1.0}, "not a finite number from 0 up"),
    ],
)
def test_classify_rejects(spark, changes, message):
    with pytest.raises(Exception, match=message):
        decisions.classify_direction(evidence(spark, **changes), require_interval_separation=True).collect()


def test_classify_thresholds(spark):
    with pytest.raises(ValueError, match="min_abs_asymmetry"):
        decisions.classify_direction(evidence(spark), min_abs_asymmetry=1.5)


def test_provisional(spark):
    rows = [("A", "B", 1.0, 0.1, 0.9, True), ("A", "B", 1.0, 0.1, 0.5, True), ("A", "B", 1.0, 1.0, 0.9, True), ("A", "B", 0.1, 1.0, 0.9, False)]
    table = spark.createDataFrame(rows, "population_a string, population_b string, m_a_to_b double, m_b_to_a double, asymmetric_model_weight double, optimizer_stable boolean")
    got = [(r["status"], r["preferred_direction"]) for r in decisions.provisional_direction(table).collect()]
    assert got == [("candidate", "A->B"), ("unsupported", None), ("ambiguous", None), ("ambiguous", "B->A")]


def test_scalar_rates(spark):
    table = spark.createDataFrame([(3.0, 1.0), (0.0, 0.0), (1.0, 0.0)], "x double, y double")
    got = table.select(
        rates.asymmetry_index(F.col("x"), F.col("y")), rates.directional_ratio(F.col("x"), F.col("y")),
        rates.directional_support(F.lit(0.8), F.col("y"), F.col("x")),
    ).collect()
    assert [tuple(r) for r in got] == [(0.5, 3.0, pytest.approx(0.2)), (0.0, 1.0, 0.5), (1.0, math.inf, pytest.approx(0.2))]


@pytest.mark.parametrize("text, want", [("true", True), (" YES ", True), ("1", True), ("False", False), ("no", False), ("0", False)])
def test_strict_bool(spark, text, want):
    table = spark.createDataFrame([(text,)], "b string")
    assert table.select(strict_bool(table, "b")).first()[0] is want


@pytest.mark.parametrize("value, kind", [("maybe", "string"), (None, "string"), (2, "int"), (1.0, "double")])
def test_strict_bool_rejects(spark, value, kind):
    table = spark.createDataFrame([(value,)], f"b {kind}")
    with pytest.raises(Exception, match="neither true nor false"):
        table.select(strict_bool(table, "b")).collect()


def places(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "population string, latitude double, longitude double, ord int")


def brute(rows, limit=None, k=None):
    def km(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(h, 1)))

    pairs = {(i, j): km(rows[i], rows[j]) for i, j in itertools.combinations(range(len(rows)), 2)}
    kept = {p for p, d in pairs.items() if limit is not None and d <= limit}
    if k is not None:
        for me in range(len(rows)):
            mine = sorted((round(d, 7), p) for p, d in pairs.items() if me in p)
            kept |= {p for _, p in mine[:k]}
    if limit is None and k is None:
        kept = set(pairs)
    return {(rows[i][0], rows[j][0]) for i, j in kept}


ROWS = [(f"P{k:03d}", -90.0 + (k * 71 % 181), -180.0 + (k * 113 % 359) + k / 100) for k in range(60)]
CITY = [(f"C{k:03d}", 10 + k * 1e-5, 20 + (k * 7 % 11) * 1e-5) for k in range(40)]
HEAP = [(f"H{k:03d}", -30.0, 100.0) for k in range(40)]


@pytest.mark.parametrize("rows", [ROWS, ROWS + CITY + HEAP, HEAP, ROWS[:2]])
@pytest.mark.parametrize("options", [{}, {"max_distance_km": 900.0}, {"k_nearest": 3}, {"max_distance_km": 400.0, "k_nearest": 2}])
def test_candidate_pairs_against_brute_force(spark, rows, options):
    got = {(r[0], r[1]) for r in geography.candidate_pairs(places(spark, rows), **options).select("population_a", "population_b").collect()}
    assert got == brute(rows, options.get("max_distance_km"), options.get("k_nearest"))


def test_pair_errors(spark):
    table = places(spark, ROWS[:3])
    with pytest.raises(ValueError, match="unique"):
        geography.candidate_pairs(table.unionByName(table))
    with pytest.raises(ValueError, match="max_distance_km"):
        geography.candidate_pairs(table, max_distance_km=0)
    with pytest.raises(ValueError, match="k_nearest"):
        geography.candidate_pairs(table, k_nearest=0)


def test_graph_options(spark):
    table = {r["neighbors"]: r for r in geography.graph_options(places(spark, ROWS)).collect()}
    assert sorted(table) == [2, 3, 4, 5]
    assert table[3]["candidate_pairs"] == len(brute(ROWS, k=3))
    assert geography.graph_options(places(spark, ROWS[:2])).count() == 0
    assert [geography.recommend_neighbors(n) for n in (1, 3, 4, 10, 11)] == [1, 2, 3, 3, 4]


FLOWS = "source string, destination string, migration double, support double, status string"
FLOW_ROWS = [("A", "B", 0.05, 0.99, "supported"), ("B", "C", 0.03, 0.96, "supported"), ("A", "C", 0.5, 0.9, "ambiguous"), ("C", "A", 0.9, 0.2, "unsupported")]


def test_network(spark):
    flows = spark.createDataFrame(FLOW_ROWS, FLOWS)
    got = {r["population"]: r for r in network.source_sink_summary(network.network_edges(flows)).collect()}
    assert {k: round(r["net_flow"], 9) for k, r in got.items()} == {"A": 0.05, "B": -0.02, "C": -0.03}
    assert got["A"]["network_role"] == "source-like" and got["C"]["network_role"] == "sink-like"
    assert (got["B"]["out_degree"], got["B"]["in_degree"]) == (1, 1)
    assert network.network_edges(flows, include_ambiguous=True).count() == 3
    twice = spark.createDataFrame([("A", "B", 0.9, 1), ("A", "B", 0.1, 2)], "source string, destination string, migration double, ord int")
    assert network.network_edges(twice, order="ord").first()["migration"] == 0.1
    assert network.source_sink_summary(network.network_edges(flows.filter("false"))).count() == 0


def test_map_edges(spark):
    flows = spark.createDataFrame(FLOW_ROWS, FLOWS)
    spots = places(spark, [("A", 0.0, 0.0), ("B", 1.0, 1.0), ("C", 2.0, 2.0)])
    assert network.map_edges(spots, flows).count() == 2
    assert network.map_edges(spots, flows, min_support=0.97).count() == 1
    drawn = {r["line_style"]: r for r in network.map_edges(spots, flows, include_ambiguous=True, min_migration=0.05).collect()}
    assert drawn["--"]["line_width"] == pytest.approx(5.0) and drawn["--"]["alpha"] == pytest.approx(0.92)
    assert drawn["-"]["line_width"] == pytest.approx(0.7 + 4.3 * math.sqrt(0.1))
    with pytest.raises(ValueError, match="without coordinates: C"):
        network.map_edges(spots.filter("population <> 'C'"), flows)
    with pytest.raises(ValueError, match="without a support column"):
        network.map_edges(spots, flows.drop("support"), min_support=0.5)


@pytest.mark.parametrize(
    "row, message",
    [
        (("A", "A", 0.1, 0.9, "supported"), "self-migration"), (("A", "B", -0.1, 0.9, "supported"), "not a finite number from 0 up"),
        (("A", "B", 0.1, 1.9, "supported"), "support is outside"), (("A", "B", 0.1, 0.9, "sure"), "a status other than"),
    ],
)
def test_flow_rules(spark, row, message):
    with pytest.raises(Exception, match=message):
        network.validate_flows(spark.createDataFrame([row], FLOWS)).collect()


def test_flow_tables(spark):
    schema = "population_a string, population_b string, status string, preferred_direction string, m_a_to_b_scaled double, m_b_to_a_scaled double, directional_support double, asymmetry_index double, asymmetric_model_weight double"
    rows = [("A", "B", "supported", "A->B", 0.9, 0.1, 0.99, 0.8, 0.9), ("A", "C", "candidate", "A->C", 0.9, 0.1, None, 0.8, 0.9), ("C", "D", "ambiguous", "D->C", 0.1, 0.3, 0.9, -0.5, 0.8), ("A", "D", "unsupported", None, None, None, None, None, 0.0)]
    table = spark.createDataFrame(rows, schema)
    edges = {(r["source"], r["destination"]): r["migration"] for r in decisions.pairwise_to_flows(table).collect()}
    assert edges == {("A", "B"): 0.9, ("D", "C"): 0.3}
    counts = {r["status"]: r["pairs"] for r in decisions.status_counts(table).collect()}
    assert counts == {"supported": 1, "ambiguous": 1, "unsupported": 1}
    assert decisions.pairwise_to_flows(table.filter("false")).columns[0] == "source"
    decided = decisions.classify_direction(evidence(spark, migration_forward=0.1, migration_reverse=1.0))
    assert decisions.decisions_to_flows(decided).select("source", "destination", "migration").first() == ("B", "A", 1.0)
