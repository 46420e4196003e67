"""Steps whose few input bytes become much work are dealt to tasks by that work."""

import random
from math import comb

from pyspark.sql import functions as F

from driftway.operators import counts, geography, models, resample
from driftway.plans import fixtures, queries
from driftway.sources import block_gzip


def most_tasks(spark, name, action):
    """The most tasks that a stage of the jobs of ``action`` had; the session has 8 shuffle partitions."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(job).stageIds]
    return max(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))


def places(spark, count):
    rng = random.Random(3)
    rows = [(f"p{k}", rng.uniform(-50, 50), rng.uniform(-170, 170), k) for k in range(count)]
    return spark.createDataFrame(rows, "population string, latitude double, longitude double, ord long").coalesce(1)


def test_pairs_within_a_distance_are_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(geography, "_PAIRS_PER_TASK", 500, raising=False)
    table = places(spark, 600)
    got = geography.candidate_pairs(table, max_distance_km=1500.0)
    assert most_tasks(spark, "within", got.collect) > 16
    a, b = geography._positioned(table).alias("a"), geography._positioned(table).alias("b")
    far = geography.haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    want = a.join(b, F.expr("a.ord < b.ord")).filter(far <= 1500.0).select("a.population", "b.population", far)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nearest_are_dealt_by_points(spark, monkeypatch):
    monkeypatch.setattr(geography, "_POINTS_PER_TASK", 50, raising=False)
    table = places(spark, 1000)
    got = geography.candidate_pairs(table, k_nearest=3)
    assert most_tasks(spark, "nearest", got.collect) > 16


def test_orders_are_joined_in_tasks_of_bounded_size(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    whole = {tuple(r) for r in counts.count_calls(fixtures.frame(spark, folder, "calls")).collect()}
    monkeypatch.setattr(fixtures, "_LINES_PER_TASK", 200, raising=False)
    got = counts.count_calls(fixtures.frame(spark, folder, "calls"))
    assert most_tasks(spark, "calls", lambda: {tuple(r) for r in got.collect()}) > 16
    assert {tuple(r) for r in got.collect()} == whole


def test_draws_are_dealt_by_draws(spark, monkeypatch):
    sizes = spark.createDataFrame([("A", "B", 30_000)], "population_a string, population_b string, n long")
    want = {tuple(r) for r in resample.draw_counts(sizes, 4, 1).collect()}
    monkeypatch.setattr(resample, "_DRAWS_PER_TASK", 5_000, raising=False)
    got = resample.draw_counts(sizes, 4, 1)
    assert most_tasks(spark, "draws", lambda: got.collect()) > 16
    assert {tuple(r) for r in got.collect()} == want and sum(r[-1] for r in want) == 4 * 30_000


def test_cells_of_a_window_are_added_in_place(spark):
    shared = spark.createDataFrame(
        [("A", "B", "c", pos, "A", "G", n, x, 9, y) for pos, n, x, y in ((5, 8, 3, 4), (6, 12, 3, 0), (150, 10, 9, 9), (151, 7, 1, 1))],
        "population_a string, population_b string, chrom string, pos long, ref string, alt string, n_a long, x_a long, n_b long, x_b long",
    )
    table = resample.block_spectra(shared, 100, 8, 8)
    assert "MapInArrow" in table._jdf.queryExecution().toString()  # no row per configuration and cell is shuffled
    got = {(r["block"], r["i"], r["j"]): r["mass"] for r in table.collect()}
    want = {}
    for block, n, x, y in ((0, 8, 3, 4), (0, 12, 3, 0), (1, 10, 9, 9)):
        for i in range(9):
            for j in range(9):
                p = [comb(a, k) * comb(m - a, 8 - k) / comb(m, 8) for m, a, k in ((n, x, i), (9, y, j))]
                if p[0] * p[1] > 0:
                    want[block, i, j] = want.get((block, i, j), 0.0) + p[0] * p[1]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_written_calls_are_dealt_to_files_by_their_lines(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = {name: {tuple(r) for r in queries.QUERIES[name](spark, folder).collect()} for name in ("vcf_file_counts", "vcf_block_gzip_counts")}
    monkeypatch.setattr(queries, "_LINES_PER_FILE", 10, raising=False)
    assert len(spark.read.text(queries.vcf_files(spark, folder)).inputFiles()) > 16
    written = []
    write = block_gzip.write_block_gzip
    monkeypatch.setattr(block_gzip, "write_block_gzip", lambda *a, **k: written.extend(write(*a, **k)) or list(written))
    assert {name: {tuple(r) for r in queries.QUERIES[name](spark, folder).collect()} for name in want} == want
    assert len(written) > 16


def test_short_ranges_share_tasks(spark, tmp_path):
    lines = spark.range(60_000).selectExpr("sha2(cast(id as string), 256) AS value").coalesce(1)
    files = block_gzip.block_gzip_files(spark, block_gzip.write_block_gzip(lines, f"file://{tmp_path}/blocks", block_text=4096))
    read = []
    most = most_tasks(spark, "ranges", lambda: read.append(block_gzip.read_block_gzip(spark, files, range_bytes=8192).collect()))
    assert files[0][1] // 8192 > 200 and most <= 2 * spark.sparkContext.defaultParallelism
    assert [r["value"] for r in sorted(read[0], key=lambda r: r["line_in_file"])] == [r["value"] for r in lines.collect()]


def test_cells_of_a_library_are_not_shuffled(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = {tuple(r) for r in queries.QUERIES["profile_interval"](spark, folder).collect()}
    monkeypatch.setattr(queries, "_ENTRIES_PER_TASK", 10, raising=False)
    library, _ = queries._library(spark, folder)
    scan = models.library_scan(queries._projected(spark, folder), library, 8, 8)
    assert most_tasks(spark, "library", scan.collect) > 16
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(model" in plan and plan.count("REPARTITION_BY_COL") == 0  # sets alone, dealt by number
    assert {tuple(r) for r in queries.QUERIES["profile_interval"](spark, folder).collect()} == want


def test_draws_and_blocks_are_merged(spark):
    """A row per block: the planner sees the one row of sizes that the draws come from, and would broadcast them."""
    blocks = spark.range(300).selectExpr(
        "'A' AS population_a", "'B' AS population_b", "'c' AS chrom", "id AS block",
        "9L AS n_a", "id % 8 AS x_a", "8L AS n_b", "id % 5 AS x_b", "2L AS loci",
    )
    offsets = spark.createDataFrame([("A", "B", 7)], "population_a string, population_b string, seed_offset long")
    got = resample.resample_block_configurations(blocks, 3, 1, 8, 8, offsets=offsets)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 2
    masses = {}
    for r in got.collect():
        masses[r["replicate"]] = masses.get(r["replicate"], 0.0) + r["mass"]
    assert masses.keys() == {0, 1, 2} and all(abs(m - 600) < 1e-6 for m in masses.values())


def test_library_entries_are_merged(spark):
    """A row per library entry on both sides of a join: neither is broadcast, however few they are."""
    folder = "/root/testdata/sf0.001"
    library, parameters = queries._library(spark, folder)
    scan = models.library_scan(queries._projected(spark, folder), library, 8, 8)
    runs = models.scan_as_runs(scan, parameters)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    by_entry = [line for line in plan.splitlines() if "Join [model#" in line]
    assert len(by_entry) == 2 and all("SortMergeJoin" in line for line in by_entry)
    assert runs.count() == scan.count() == 10 * parameters.count()


def test_plans_do_not_hold_a_step_for_each_of_its_readers(spark):
    runs = spark.range(200).selectExpr(
        "id % 2 AS pair_id", "id AS run", "id % 7 <> 0 AS success", "-10D - id % 5 AS log_likelihood",
        "map('m_a_to_b', 1D + id % 3, 'm_b_to_a', 0.5D) AS params",
    )
    table = models.multistart_summary(runs, ["pair_id"])
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1  # its ranked runs are written
    assert {r["pair_id"]: (r["best_run"], r["near_best_runs"]) for r in table.collect()} == {0: (10, 22), 1: (5, 22)}
    pairwise = queries.QUERIES["infer_pairs"](spark, "/root/testdata/sf0.001")
    # numbers of loci, decisions, pairs without a direction, and cells
    assert pairwise._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 4
    assert pairwise.count() == 10
