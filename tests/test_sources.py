import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from driftway.operators import counts as counting
from driftway.operators import inspection, spectra
from driftway.sources import block_gzip, inventory, sinks, tables, vcf

HEADER = "##source=made-up\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA1\tA2\tB1\tB2\n"
#: A record with depths and a phased call, one with missing calls, one with two alternatives, and an empty line.
RECORDS = (
    ("7", 412, "G", "C", "GT:DP", "0|1:8", "0/0:5", "1/1:6", "1|0:7"),
    ("7", 655, "T", "A", "GT", "0/0", "./.", "1/1", "0/1"),
    ("7", 803, "A", "C,T", "GT", "0/1", "1/1", "0/0", "0/2"),
)
VCF = HEADER + "".join(
    "\t".join([chrom, str(pos), ".", ref, alt, ".", "q10", ".", form, *calls]) + "\n" for chrom, pos, ref, alt, form, *calls in RECORDS
) + "\n"
POPMAP = [("A1", "A"), ("A2", "A"), ("B1", "B"), ("B2", "B")]


def popmap(spark, rows=POPMAP):
    return spark.createDataFrame(rows, "sample string, population string")


def found(counts):
    return {(r["pos"], r["population"]): (r["alt_count"], r["called_chromosomes"]) for r in counts.collect()}


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("scan", [False, True])
def test_vcf_counts(spark, tmp_path, scan):
    path = write(tmp_path / "x.vcf", VCF)
    got = found(vcf.allele_counts_from_vcf(spark, path, popmap(spark), scan_headers=scan))
    assert got == {(412, "A"): (1, 4), (412, "B"): (3, 4), (655, "A"): (0, 2), (655, "B"): (3, 4)}


def test_gzip_and_minimum(spark, tmp_path):
    path = str(tmp_path / "x.vcf.gz")
    with gzip.open(path, "wt") as handle:
        handle.write(VCF)
    counts = vcf.allele_counts_from_vcf(spark, path, popmap(spark), min_called_chromosomes=3, partitions=4)
    assert (655, "A") not in found(counts) and found(counts)[(412, "A")] == (1, 4)
    with pytest.raises(ValueError, match="1 or more"):
        vcf.allele_counts_from_vcf(spark, path, popmap(spark), min_called_chromosomes=0)


def test_genotype_edge_cases(spark, tmp_path):
    calls = ["0", "1|0|1", "0/2", "./1", ".", "5:0/1", "0/a", "1/1"]
    names = [f"S{k}" for k in range(len(calls))]
    head = HEADER.splitlines()[1].split("\t")[:9] + names
    record = ["chr1", "5", ".", "A", "G", ".", ".", ".", "GT", *calls]
    deep = ["chr1", "6", ".", "A", "G", ".", ".", ".", "DP:GT", *["7:0/1", "7", "./.", "9:1", *["."] * 4]]
    no_gt = ["chr1", "7", ".", "A", "G", ".", ".", ".", "DP", *["3"] * 8]
    short = ["chr1", "8", ".", "A", "G", ".", ".", ".", "GT"]
    text = "\n".join("\t".join(r) for r in (head, record, deep, no_gt, short)) + "\n"
    path = write(tmp_path / "x.vcf", text)
    got = found(vcf.allele_counts_from_vcf(spark, path, popmap(spark, [(n, "P") for n in names])))
    # 0 -> (0, 1); 1|0|1 -> (2, 3); 1/1 -> (2, 2); the second line has 0/1 and a haploid 1.
    assert got == {(5, "P"): (4, 6), (6, "P"): (2, 3)}


def test_repeated_locus_keeps_the_first_line(spark, tmp_path):
    lines = ["chr1\t10\t.\tA\tG\t.\t.\t.\tGT\t1/1\t1/1\t0/0\t0/0", "chr1\t10\t.\tA\tG\t.\t.\t.\tGT\t0/0\t0/0\t1/1\t1/1"]
    path = write(tmp_path / "x.vcf", HEADER + "\n".join(lines) + "\n")
    counts = vcf.allele_counts_from_vcf(spark, path, popmap(spark))
    assert counts.count() == 4
    firsts = {r["population"]: r["alt_count"] for r in spectra.first_counts(counts).collect()}
    assert firsts == {"A": 4, "B": 0}


def test_vcf_errors(spark, tmp_path):
    path = write(tmp_path / "x.vcf", VCF)
    with pytest.raises(ValueError, match="no VCF file has: Z1, Z2"):
        vcf.allele_counts_from_vcf(spark, path, popmap(spark, [*POPMAP, ("Z2", "A"), ("Z1", "A")]))
    headless = write(tmp_path / "y.vcf", VCF.split("\n", 2)[2])
    for scan in (False, True):
        with pytest.raises(ValueError, match="no #CHROM line"):
            vcf.allele_counts_from_vcf(spark, headless, popmap(spark), scan_headers=scan)


def test_several_files_with_different_columns(spark, tmp_path):
    swapped = VCF.replace("A1\tA2\tB1\tB2", "B1\tB2\tA1\tA2").replace("\n7\t", "\n8\t")
    paths = [write(tmp_path / "x.vcf", VCF), write(tmp_path / "y.vcf", swapped)]
    counts = vcf.allele_counts_from_vcf(spark, paths, popmap(spark))
    got = {(r["chrom"], r["pos"], r["population"]): r["alt_count"] for r in counts.collect()}
    assert got[("7", 412, "A")] == 1 and got[("8", 412, "A")] == 3


def test_count_calls_ignores_unreadable(spark):
    calls = spark.createDataFrame(
        [("c", 1, "A", "G", "P", 1, 2), ("c", 1, "A", "G", "P", None, None), ("c", 1, "A", "G", "Q", None, None)],
        "chrom string, pos long, ref string, alt string, population string, alt_n int, called int",
    )
    rows = counting.count_calls(calls).collect()
    assert [(r["population"], r["ref_count"], r["alt_count"]) for r in rows] == [("P", 1, 1)]
    totals = inspection.dataset_totals(counting.count_calls(calls), popmap(spark)).first()
    assert (totals["samples"], totals["populations"], totals["loci"]) == (4, 2, 1)


@pytest.mark.parametrize("separator", ["\t", ","])
def test_popmap(spark, tmp_path, separator):
    rows = [("sample", "population"), *POPMAP]
    path = write(tmp_path / "p.txt", "\n".join(separator.join(r) for r in rows))
    assert tables.read_popmap(spark, path).count() == 4
    twice = write(tmp_path / "q.txt", "\n".join(separator.join(r) for r in [*rows, ("A1", "B")]))
    with pytest.raises(ValueError, match="more than once: A1"):
        tables.read_popmap(spark, twice)
    with pytest.raises(ValueError, match="without a sample or a population"):
        tables.validate_popmap(popmap(spark, [("A1", "")]))


def test_coordinates(spark, tmp_path):
    path = write(tmp_path / "c.csv", "population,latitude,longitude,x\nA,1,2,z\nA,3,4,z\n")
    assert tables.read_coordinates(spark, path, unique=False).columns == ["population", "latitude", "longitude"]
    with pytest.raises(ValueError, match="more than one row of coordinates"):
        tables.read_coordinates(spark, path)
    for row, message in ((("A", "100", "0"), "latitude is outside"), (("A", "x", "0"), "not a finite number")):
        frame = spark.createDataFrame([row], "population string, latitude string, longitude string")
        with pytest.raises(ValueError, match=message):
            tables.validate_coordinates(frame)
    with pytest.raises(ValueError, match="without coordinates: B"):
        tables.missing_coordinates(popmap(spark), spark.createDataFrame([("A", 1.0, 2.0)], "population string, latitude double, longitude double"))


def test_thresholds_file(spark, tmp_path):
    record = {"min_model_weight": 0.7, "min_directional_support": 0.95, "min_abs_asymmetry": 0.25}
    nested = write(tmp_path / "t.json", json.dumps({"selected_thresholds": record, "other": 1}))
    row = tables.load_thresholds(spark, nested).first()
    assert row["min_model_weight"] == 0.7 and row["evaluated_rows"] == 0 and row["called_fraction"] is None
    csv = write(tmp_path / "t.csv", ",".join(record) + "\n0.7,0.95,1.5\n")
    with pytest.raises(ValueError, match="0 to 1.*min_abs_asymmetry"):
        tables.load_thresholds(spark, csv)
    two = write(tmp_path / "u.csv", ",".join(record) + "\n.7,.9,.5\n.7,.9,.5\n")
    with pytest.raises(ValueError, match="one threshold record"):
        tables.load_thresholds(spark, two)
    with pytest.raises(FileNotFoundError):
        tables.load_thresholds(spark, str(tmp_path / "none.csv"))


def test_inventory(spark, tmp_path):
    (tmp_path / "r" / "sub").mkdir(parents=True)
    root = tmp_path / "r"
    (root / "a.txt").write_bytes(b"abc")
    (root / "sub" / "b.txt").write_bytes(b"hello")
    (root / "validation_archive_manifest.json").write_text("{}")
    listed = inventory.file_inventory(spark, str(root))
    got = {r["path"]: (r["bytes"], r["sha256"]) for r in listed.collect()}
    assert got == {
        "a.txt": (3, hashlib.sha256(b"abc").hexdigest()),
        "sub/b.txt": (5, hashlib.sha256(b"hello").hexdigest()),
    }
    totals = inventory.inventory_totals(listed).first()
    assert (totals["file_count"], totals["total_bytes"]) == (2, 8)
    inventory.write_manifest(listed, str(tmp_path / "m"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "m.sha256")).orderBy("value").collect()]
    assert sorted(lines) == sorted(f"{digest}  {path}" for path, (_, digest) in got.items())
    with pytest.raises(ValueError, match="no folder of results"):
        inventory.file_inventory(spark, str(tmp_path / "none"))
    assert inventory.input_records(spark, {"one": str(root / "a.txt")}).first()["size_bytes"] == 3


def test_result_tables_and_spectra(spark, tmp_path):
    folder = str(tmp_path)
    sinks.write_table(popmap(spark), folder, "pairwise_results")
    write(tmp_path / "network_summary.csv", "population,net\nA,1\n")
    read = tables.read_result_tables(spark, folder)
    assert set(read) == {"pairwise_results", "network_summary"}
    cells = spark.createDataFrame([("A", "B", 0, 1, 2.0), ("A", "C", 0, 1, 3.0)], "population_a string, population_b string, i int, j int, mass double")
    path = sinks.write_spectra(cells, folder)
    assert [r["mass"] for r in tables.read_spectra(spark, path, "A", "C").collect()] == [3.0]


def block_file(path, text, size):
    path.write_bytes(b"".join(block_gzip.blocked(iter([text.encode()]), size)))
    return str(path)


@pytest.mark.parametrize("size, range_bytes", [(40, 64), (300, 100), (300, 1000), (65_280, 1 << 20)])
def test_block_gzip_lines_are_those_of_the_text(spark, tmp_path, size, range_bytes):
    rng = random.Random(size)
    texts = {
        "plain": "".join("x" * rng.choice([0, 1, 7, 30, 500]) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(400)),
        "no-end": "one\ntwo\nthree é", "empty": "", "blank": "\n\n\n", "long": "a" * 5000 + "\n" + "b" * 5000 + "\nend\n",
    }
    for name, text in texts.items():
        path = block_file(tmp_path / f"{name}.gz", text, size)
        assert gzip.decompress(open(path, "rb").read()).decode() == text
        want, at = [], 0
        for line in text.encode().split(b"\n")[: None if not text.endswith("\n") else -1] if text else []:
            want.append((at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
        found = block_gzip.read_block_gzip(spark, block_gzip.block_gzip_files(spark, [path]), range_bytes)
        assert sorted((r["line_in_file"], r["value"]) for r in found.collect()) == want


def test_block_gzip_counts_come_from_many_tasks(spark, tmp_path):
    records = [f"1\t{p}\t.\tA\tG\t.\tPASS\t.\tGT\t0/1\t1/1\t0/0" for p in range(1, 800)]
    again = [f"1\t{p}\t.\tA\tG\t.\tPASS\t.\tGT\t1/1\t1/1\t1/1" for p in range(1, 800, 5)]
    names = [name for name, _ in POPMAP[:3]]
    fixed = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    text = "\n".join(["##source=test", fixed, *records, *again]) + "\n"
    plain, whole = tmp_path / "plain.vcf", tmp_path / "whole.vcf.gz"
    plain.write_text(text)
    whole.write_bytes(gzip.compress(text.encode()))
    path = block_file(tmp_path / "blocks.vcf.gz", text, 700)
    people = popmap(spark, POPMAP[:3])
    tables, parts = [], []
    for name in (str(plain), str(whole), path):
        lines = vcf.read_vcf_lines(spark, name, range_bytes=512)
        counts = vcf.allele_counts_from_lines(lines, vcf.read_headers(spark, name), people)
        first = spectra.first_counts(counts).select("pos", "population", "alt_count", "called_chromosomes")
        tables.append(sorted(map(tuple, first.collect())))
        parts.append(lines.select(F.spark_partition_id().alias("k")).distinct().count())
        ordered = [r["value"] for r in lines.orderBy("line_in_file").collect()]
        assert ordered == text.splitlines()
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) > 799
    assert parts[1] == 1 and parts[2] > 4  # ordinary gzip is one task


def test_broken_block_files_are_errors(spark, tmp_path):
    path = block_file(tmp_path / "cut.gz", "some line\n" * 400, 300)
    data = open(path, "rb").read()
    for broken in (data[:-100], data[:200] + bytes([data[200] ^ 255]) + data[201:]):
        (tmp_path / "cut.gz").write_bytes(broken)
        with pytest.raises(Exception):
            block_gzip.read_block_gzip(spark, [(path, len(broken))], 256).collect()
    (tmp_path / "text.gz").write_bytes(b"not compressed at all")
    assert block_gzip.block_gzip_files(spark, [str(tmp_path / "text.gz")]) == []
