"""Variant-call text as DataFrames: headers, records and per-population allele counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftway.functions import genotype
from driftway.functions.checks import first_values, require_columns
from driftway.session import broadcast_if_small
from driftway.sources import block_gzip

HEADERS_SCHEMA = "file_path string, header string, orphan_record boolean"

# line_no = file ordinal * 2^41 + byte offset of the split + row within the task:
# unique, and increasing in file order because a task never reads more lines than bytes.
# Room for four million files of two terabytes each.
_FILE_STRIDE = 1 << 41
_ROW_MASK = (1 << 33) - 1


def _same_name(path: Column) -> Column:
    """One spelling for local files, which Spark names with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_vcf_lines(
    spark: SparkSession, path: str | list[str], partitions: int | None = None, *, split_blocks: bool = True,
    range_bytes: int = block_gzip.RANGE_BYTES,
) -> DataFrame:
    """Text lines with their file and an order within it.

    Block-compressed files (bgzip) are read by a task for each ``range_bytes``. Other
    ``.gz`` files decompress in one task each; pass ``partitions`` to spread their
    lines before the genotype work starts. ``split_blocks=False`` reads all as
    ordinary gzip, for file systems Arrow cannot open.
    """
    lines = _split_lines(spark, path, range_bytes) if split_blocks else _text_lines(spark, path)
    return lines.repartition(partitions) if partitions else lines


def _split_lines(spark: SparkSession, path: str | list[str], range_bytes: int) -> DataFrame:
    files = spark.read.text(path).inputFiles()
    packed = [name for name in files if name.endswith((".gz", ".bgz"))]
    blocks = block_gzip.block_gzip_files(spark, packed)
    if not blocks:
        return _text_lines(spark, path)
    found = block_gzip.read_block_gzip(spark, blocks, range_bytes).withColumn("file_path", _same_name(F.col("file_path")))
    others = sorted(set(files) - {name for name, _ in blocks})
    return found.unionByName(_text_lines(spark, others)) if others else found


def _text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(
        "value",
        _same_name(F.col("_metadata.file_path")).alias("file_path"),
        (
            F.col("_metadata.file_block_start")
            + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK))
        ).alias("line_in_file"),
    )


def read_headers(spark: SparkSession, path: str | list[str], lines: DataFrame | None = None) -> DataFrame:
    """One row per file: its ``#CHROM`` line, or a mark that a record came first.

    Tasks open each file and stop at the header, so large inputs are not read
    twice. Give ``lines`` to find headers by scanning instead, for file systems
    Arrow cannot open.
    """
    if lines is not None:
        mark = F.col("value").startswith("#CHROM")
        record = (F.length("value") > 0) & ~F.col("value").startswith("#")
        first_record = F.min(F.when(record, F.col("line_in_file")))
        header_at = F.min(F.when(mark, F.col("line_in_file")))
        return lines.groupBy("file_path").agg(
            F.min_by("value", F.when(mark, F.col("line_in_file"))).alias("header"),
            F.coalesce(first_record < header_at, first_record.isNotNull()).alias("orphan_record"),
        )

    files = spark.read.text(path).inputFiles()

    def open_heads(batches):
        import io

        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name in batch["file_path"]:
                system, location = fs.FileSystem.from_uri(name)
                packed = "gzip" if name.endswith((".gz", ".bgz")) else "detect"
                with system.open_input_stream(location, compression=packed) as raw:
                    header, orphan = None, False
                    for line in io.TextIOWrapper(raw, encoding="utf-8"):
                        line = line.rstrip("\n")
                        if line.startswith("#CHROM"):
                            header = line
                            break
                        if line and not line.startswith("#"):
                            orphan = True
                            break
                rows.append((name, header, orphan))
            yield pd.DataFrame(rows, columns=["file_path", "header", "orphan_record"])

    listing = spark.createDataFrame([(name,) for name in files], "file_path string")
    spread = listing.repartition(max(1, min(len(files), 1024)), "file_path")
    return spread.mapInPandas(open_heads, HEADERS_SCHEMA).withColumn("file_path", _same_name(F.col("file_path")))


def checked_headers(headers: DataFrame) -> DataFrame:
    """Headers with an id shared by files that have the same sample columns."""
    if headers.filter("orphan_record").limit(1).count():
        raise ValueError("a VCF file has records but no #CHROM line before them.")
    return headers.filter(F.col("header").isNotNull()).select(
        "file_path",
        F.xxhash64("header").alias("header_id"),
        F.slice(F.split("header", "\t", -1), 10, 1 << 30).alias("samples"),
    )


def file_numbers(headers: DataFrame) -> DataFrame:
    """(file_path, header_id, file_no), numbered along the path.

    The window holds one narrow row per file; it gives ties between files an
    order that does not depend on the listing.
    """
    numbered = F.row_number().over(Window.orderBy("file_path")) - 1
    return headers.select("file_path", "header_id").withColumn("file_no", numbered.cast("long"))


def sample_columns(headers: DataFrame, popmap: DataFrame, check: bool = True) -> DataFrame:
    """(header_id, column, population) of mapped samples; popmap samples a file lacks are an error."""
    layouts = headers.dropDuplicates(["header_id"]).select(
        "header_id", F.posexplode("samples").alias("column", "sample")
    )
    if check:
        expected = popmap.count()
        found = layouts.join(popmap, "sample").groupBy("header_id")
        complete = found.agg(F.count_distinct("sample").alias("found")).filter(F.col("found") == expected)
        short = headers.select("header_id").join(complete, "header_id", "left_anti").first()
        if short is not None and expected:
            present = layouts.filter(F.col("header_id") == short["header_id"])
            absent = popmap.join(present, "sample", "left_anti")
            names = ", ".join(row[0] for row in first_values(absent, "sample", limit=1000))
            raise ValueError(f"mapped samples that no VCF file has: {names}")
    return layouts.join(popmap.select("sample", "population"), "sample").select(
        "header_id", "column", "population"
    )


def vcf_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Biallelic records that declare GT, split into their parts.

    Comment and blank lines, records with fewer than ten fields, several ALT
    alleles or no GT in FORMAT are left out. FILTER and QUAL are not looked at.
    """
    keep = [name for name in lines.columns if name != value]
    text = lines.filter((F.length(value) > 0) & ~F.col(value).startswith("#"))
    # The limit keeps the sample part in one piece until the record is accepted.
    parts = text.select(*keep, F.split(value, "\t", 10).alias("part"))
    parts = parts.filter(F.size("part") >= 10).filter(~F.col("part")[4].contains(","))
    gt_position = F.array_position(F.split(F.col("part")[8], ":"), "GT").cast("int")
    records = parts.select(
        *keep,
        F.col("part")[0].alias("chrom"),
        F.col("part")[1].cast("long").alias("pos"),
        F.col("part")[3].alias("ref"),
        F.col("part")[4].alias("alt"),
        gt_position.alias("gt_position"),
        F.col("part")[9].alias("calls"),
    )
    return records.filter("gt_position > 0")


def count_alleles(
    records: DataFrame,
    columns: DataFrame,
    *,
    min_called_chromosomes: int = 1,
    on: tuple[str, ...] = ("column",),
) -> DataFrame:
    """Allele counts per record line and population.

    Each call is reduced to one packed long and summed map-side per line and
    population, so the shuffle carries result rows, not genotypes.
    """
    if min_called_chromosomes < 1:
        raise ValueError("min_called_chromosomes must be 1 or more.")
    carried = ["line_no", "chrom", "pos", "ref", "alt", "gt_position"] + [k for k in on if k != "column"]
    fields = records.select(*carried, F.posexplode_outer(F.split("calls", "\t", -1)).alias("column", "field"))
    placed = fields.join(broadcast_if_small(columns), list(on))
    gt = genotype.genotype_text(F.col("field"), F.col("gt_position"))
    locus = ["line_no", "chrom", "pos", "ref", "alt", "population"]
    calls = placed.select(*locus, gt.alias("gt")).select(
        *locus, genotype.packed_alleles(F.col("gt")).alias("packed")
    )
    summed = calls.groupBy(*locus).agg(F.sum("packed").alias("packed"))
    called = genotype.unpack_called(F.col("packed"))
    alt = genotype.unpack_alt(F.col("packed"))
    counts = summed.select(
        "chrom",
        "pos",
        "ref",
        "alt",
        "population",
        (called - alt).alias("ref_count"),
        alt.alias("alt_count"),
        called.alias("called_chromosomes"),
        "line_no",
    )
    return counts.filter(F.col("called_chromosomes") >= min_called_chromosomes)


def allele_counts_from_lines(
    lines: DataFrame, headers: DataFrame, popmap: DataFrame, *, min_called_chromosomes: int = 1
) -> DataFrame:
    """Allele counts of text lines (value, file_path, line_in_file) with the headers of their files."""
    require_columns(popmap, ("sample", "population"), "popmap")
    headers = checked_headers(headers)
    columns = sample_columns(headers, popmap)
    records = vcf_records(lines).join(broadcast_if_small(file_numbers(headers)), "file_path")
    records = records.withColumn("line_no", F.col("file_no") * F.lit(_FILE_STRIDE) + F.col("line_in_file"))
    return count_alleles(
        records, columns, min_called_chromosomes=min_called_chromosomes, on=("header_id", "column")
    )


def allele_counts_from_vcf(
    spark: SparkSession,
    path: str | list[str],
    popmap: DataFrame,
    *,
    min_called_chromosomes: int = 1,
    partitions: int | None = None,
    scan_headers: bool = False,
) -> DataFrame:
    """Allele counts of one or many VCF files, plain or gzip-compressed."""
    lines = read_vcf_lines(spark, path, partitions, split_blocks=not scan_headers)
    headers = read_headers(spark, path, lines if scan_headers else None)
    return allele_counts_from_lines(lines, headers, popmap, min_called_chromosomes=min_called_chromosomes)
