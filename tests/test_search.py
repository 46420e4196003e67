"""The pruned library search against the full scan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from driftway.operators import models, search

KEYS = ["p"]
SIZE = 7


def spectra_of(spark, count=11):
    rng = random.Random(4)
    rows = []
    for p in range(count):
        for i in range(SIZE + 1):
            for j in range(SIZE + 1):
                mass = round(rng.random() * 40 * math.exp(-abs(i - j) * (p + 1) / 6) / (1 + i + j), 3)
                if mass > 0.2:
                    rows.append((p, i, j, mass))
    return spark.createDataFrame(rows, "p int, i long, j long, mass double")


def library_of(spark, entries=120):
    rows = []
    for model, tilt in (("symmetric_migration", 0.0), ("asymmetric_migration", 0.02)):
        for k in range(entries):
            for i in range(SIZE + 1):
                for j in range(SIZE + 1):
                    expected = math.exp(-abs(i - j) * (k % 40 + 1) / 10) / (1 + i + j) + tilt * j * (k % 7)
                    if (model, k, i) != ("symmetric_migration", 3, 5):  # an entry that expects nothing in some cells
                        rows.append((model, k, i, j, expected))
    return spark.createDataFrame(rows, "model string, param_id long, i long, j long, expected double")


@pytest.mark.parametrize("polarized", [False, True])
def test_best_entries_are_those_of_the_full_scan(spark, polarized):
    cells, library = spectra_of(spark), library_of(spark)
    scan = models.library_scan(cells, library, SIZE, SIZE, KEYS, polarized=polarized)
    want = search.best_of(scan, ["p", "model"]).collect()
    got = search.best_entries(cells, library, SIZE, SIZE, KEYS, polarized=polarized)
    assert got.columns == ["p", "model", "param_id", "log_likelihood", "theta"]
    one, two = ({(r["p"], r["model"]): (r["param_id"], r["log_likelihood"], r["theta"]) for r in rows} for rows in (got.collect(), want))
    assert one.keys() == two.keys() and len(one) == 22
    for key in one:
        assert one[key][0] == two[key][0] and one[key][1:] == pytest.approx(two[key][1:], rel=1e-12)


def test_few_entries_are_scored(spark):
    cells, library = spectra_of(spark), library_of(spark)
    found = search.LibrarySearch(cells, library, SIZE, SIZE, KEYS)
    scored = found.candidates(found.totals.select(*search.ENTRY), ["model"])
    everything = 11 * 240
    assert 22 <= scored.count() < everything / 4


def test_profiles_are_those_of_the_full_scan(spark):
    cells, library = spectra_of(spark, 3), library_of(spark)
    rate = ((F.col("param_id") % 40 + 1) / 10).alias("m")
    parameters = library.select("model", "param_id").distinct().select(
        "model", "param_id", F.create_map(F.lit("m_a_to_b"), rate, F.lit("m_b_to_a"), F.col("param_id") % 7 / 1.0).alias("params")
    )
    scan = models.library_scan(cells, library, SIZE, SIZE, KEYS)
    want = models.profile_scan(scan, parameters, "m_a_to_b", KEYS).collect()
    got = search.profile_scan(cells, library, parameters, "m_a_to_b", SIZE, SIZE, KEYS).collect()
    one, two = ({(r["p"], r["fixed_value"]): r["log_likelihood"] for r in rows} for rows in (got, want))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-12) for k in one)
    with pytest.raises(ValueError):
        search.profile_scan(cells, library, parameters, "nu_a", SIZE, SIZE, KEYS)


def test_hopeless_entries_and_ties(spark):
    cells = spark.createDataFrame([(1, 1, 1, 4.0), (1, 2, 1, 2.0)], "p int, i long, j long, mass double")
    rows = [("isolation", k, i, j, 1.0) for k in (5, 3, 9) for i in range(SIZE + 1) for j in range(SIZE + 1)]
    rows += [("symmetric_migration", k, 1, 1, 1.0) for k in (8, 2)]  # nothing expected in a cell with data
    library = spark.createDataFrame(rows, "model string, param_id long, i long, j long, expected double")
    got = {r["model"]: r for r in search.best_entries(cells, library, SIZE, SIZE, KEYS, polarized=True).collect()}
    assert got["isolation"]["param_id"] == 3 and math.isfinite(got["isolation"]["log_likelihood"])
    assert got["symmetric_migration"]["param_id"] == 2 and got["symmetric_migration"]["log_likelihood"] == -math.inf


def test_entries_are_not_sent_through_the_driver(spark, capsys):
    found = search.LibrarySearch(spectra_of(spark, 2), library_of(spark), SIZE, SIZE, KEYS)
    parts = found.totals.select(*search.ENTRY)
    found._clusters(parts, ["param_id"]).explain()
    found.scores(parts.withColumn("slot", F.lit(0).cast("long"))).explain()
    plan = capsys.readouterr().out
    merged = [line for line in plan.splitlines() if "SortMergeJoin" in line and "model" in line]
    assert len(merged) >= 3 and not [line for line in plan.splitlines() if "HashJoin [" in line and "param_id" in line and "LeftSemi" not in line]
