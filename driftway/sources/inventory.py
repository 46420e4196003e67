"""File inventories with checksums, and the manifests written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftway.sources.tables import path_exists

_CHUNK = 4 << 20


def _hashed(spark: SparkSession, names: list[str]) -> DataFrame:
    """(uri, bytes, sha256) of each file, read in chunks by a task of its own, whatever its size."""

    def run(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name in batch["uri"]:
                system, location = fs.FileSystem.from_uri(name)
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(location, compression=None) as raw:
                    while chunk := raw.read(_CHUNK):
                        digest.update(chunk)
                        size += len(chunk)
                rows.append((name, size, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["uri", "bytes", "sha256"])

    listing = spark.createDataFrame([(name,) for name in names], "uri string")
    return listing.repartition(max(1, min(len(names), 1024)), "uri").mapInPandas(run, "uri string, bytes long, sha256 string")


def _files_below(spark: SparkSession, path: str) -> list[str]:
    """URIs of a file, or of all files below a folder."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.listFiles(root, True)
    out = []
    while found.hasNext():
        out.append(found.next().getPath().toUri().toString())
    return sorted(out)

# The manifest's own files, left out of the inventory.
MANIFEST_NAMES = ("validation_archive_manifest.json", "validation_archive_manifest.sha256")


def file_inventory(spark: SparkSession, folder: str, *, exclude_manifest: bool = True) -> DataFrame:
    """(path, bytes, sha256) of every file below ``folder``.

    The driver lists names only; each file is hashed in chunks by a task, so its size does not matter.
    """
    if not path_exists(spark, folder):
        raise ValueError(f"there is no folder of results at {folder}")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root)
    prefix = root.toUri().toString().rstrip("/") + "/"
    listed = _hashed(spark, _files_below(spark, folder)).select(
        F.expr(f"substring(uri, {len(prefix) + 1})").alias("path"), "bytes", "sha256"
    )
    return listed.filter(~F.col("path").isin(*MANIFEST_NAMES)) if exclude_manifest else listed


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """File count and total bytes; an empty folder fails."""
    totals = inventory.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes")
    )
    empty = F.raise_error(F.lit("validation results directory contains no files.")).cast("long")
    return totals.withColumn("file_count", F.when(F.col("file_count") > 0, F.col("file_count")).otherwise(empty))


def write_manifest(inventory: DataFrame, output: str) -> None:
    """The inventory as JSON lines and as ``sha256  path`` checksum lines, ordered by path."""
    ordered = inventory.orderBy("path")
    ordered.write.mode("overwrite").json(output + ".json")
    ordered.select(F.concat_ws("  ", "sha256", "path").alias("value")).write.mode("overwrite").text(
        output + ".sha256"
    )


def input_records(spark: SparkSession, inputs: dict[str, str]) -> DataFrame:
    """(name, path, size_bytes, sha256) of a run's named input files."""
    if not inputs:
        raise ValueError("at least one input is required.")
    files = [(name, path, uri) for name, path in sorted(inputs.items()) for uri in _files_below(spark, path)]
    named = spark.createDataFrame(files, "name string, path string, uri string")
    return named.join(_hashed(spark, sorted({uri for _, _, uri in files})), "uri").select(
        "name", "path", F.col("bytes").alias("size_bytes"), "sha256"
    )
