"""Readers of the tabular inputs: maps, coordinates, replicate tables, thresholds, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from driftway.functions.checks import as_number, first_values, is_finite, require_columns

# File names of a finished run.
RESULT_TABLES = (
    "pairwise_results",
    "model_rankings",
    "directional_flows",
    "network_summary",
    "run_metadata",
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _listed(names: list[str], total: int | None = None) -> str:
    """Names for a message, and how many more there are."""
    more = (total or len(names)) - len(names)
    return ", ".join(names) + (f" and {more} more" if more > 0 else "")


def read_popmap(spark: SparkSession, path: str) -> DataFrame:
    """Sample-to-population map, tab or comma separated, everything text."""
    heading = spark.read.text(path).first()
    separator = "\t" if heading and "\t" in heading[0] else ","
    table = spark.read.csv(path, sep=separator, header=True, inferSchema=False)
    return validate_popmap(table)


def validate_popmap(table: DataFrame) -> DataFrame:
    if not {"sample", "population"} <= set(table.columns):
        raise ValueError("the population map needs a column sample and a column population.")
    table = table.select(F.col("sample").cast("string"), F.col("population").cast("string"))
    empty = F.col("sample").isNull() | F.col("population").isNull()
    empty = empty | (F.col("sample") == "") | (F.col("population") == "")
    if table.filter(empty).limit(1).count():
        raise ValueError("the population map has rows without a sample or a population.")
    repeated = table.groupBy("sample").count().filter("count > 1")
    names = first_values(repeated, "sample")
    if names:
        raise ValueError("samples mapped more than once: " + _listed([row[0] for row in names]))
    return table


def read_coordinates(spark: SparkSession, path: str, *, unique: bool = True) -> DataFrame:
    """Population coordinates; with ``unique`` a repeated population is an error."""
    table = spark.read.csv(path, header=True, inferSchema=False)
    if not {"population", "latitude", "longitude"} <= set(table.columns):
        raise ValueError("coordinates need the columns population, latitude and longitude.")
    table = table.select(
        "population", F.col("latitude").cast("double"), F.col("longitude").cast("double")
    )
    if unique and first_values(table.groupBy("population").count().filter("count > 1"), "population"):
        raise ValueError("a population has more than one row of coordinates.")
    return table


def validate_coordinates(table: DataFrame) -> DataFrame:
    """Coordinates checked in one aggregate: unique, numeric, finite and on the globe."""
    require_columns(table, ("population", "latitude", "longitude"), "coordinates")
    frame = table.select(
        "population", as_number(table, "latitude").alias("latitude"), as_number(table, "longitude").alias("longitude")
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    found = frame.agg(
        F.count_if(~is_finite(lat)).alias("bad_lat"),
        F.count_if(~is_finite(lon)).alias("bad_lon"),
        F.count_if(~lat.between(-90, 90)).alias("far_lat"),
        F.count_if(~lon.between(-180, 180)).alias("far_lon"),
    ).first()
    if frame.groupBy("population").count().filter("count > 1").limit(1).count():
        raise ValueError("a population has more than one pair of coordinates.")
    for name, message in (
        ("bad_lat", "latitude has a value that is not a finite number."),
        ("bad_lon", "longitude has a value that is not a finite number."),
        ("far_lat", "latitude is outside -90 to 90."),
        ("far_lon", "longitude is outside -180 to 180."),
    ):
        if found[name]:
            raise ValueError(message)
    return frame


def missing_coordinates(popmap: DataFrame, coordinates: DataFrame) -> None:
    """Every mapped population needs a coordinate."""
    absent = popmap.select("population").distinct().join(coordinates, "population", "left_anti")
    names = first_values(absent, "population", limit=1000)
    if names:
        raise ValueError("mapped populations without coordinates: " + _listed([row[0] for row in names], absent.count()))


def read_replicates(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Evidence, grid-summary or method tables from CSV or Parquet.

    Give a schema for large CSV input; without one every column is text, which
    the strict validators parse themselves.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


#: Columns of a threshold record: those it must have, and those it may have.
_THRESHOLDS = ("min_model_weight", "min_directional_support", "min_abs_asymmetry")
_THRESHOLD_RATES = (
    "false_directional_positive_rate", "directional_sensitivity", "direction_accuracy_when_called", "called_fraction",
)


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """The one threshold record of a CSV or JSON file, with numbers for all known columns and null for absent rates."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no thresholds at {path}")
    is_json = path.lower().endswith(".json")
    table = spark.read.json(path, multiLine=True) if is_json else spark.read.csv(path, header=True)
    if is_json and "selected_thresholds" in table.columns:
        table = table.select("selected_thresholds.*")
    require_columns(table, _THRESHOLDS, "threshold record")

    def number(name: str) -> Column:
        return as_number(table, name) if name in table.columns else F.lit(None).cast("double")

    typed = table.select(
        *[number(name).alias(name) for name in (*_THRESHOLDS, *_THRESHOLD_RATES)],
        F.coalesce(number("evaluated_rows").cast("long"), F.lit(0).cast("long")).alias("evaluated_rows"),
    )
    first, *more = typed.take(2) or [None]
    if first is None or more:
        raise ValueError(f"{path} must hold one threshold record, neither none nor several.")
    outside = [name for name in _THRESHOLDS if first[name] is None or not 0 <= first[name] <= 1]
    if outside:
        raise ValueError(f"not a number from 0 to 1 in {path}: {', '.join(outside)}")
    return typed


def read_result_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The result tables of a run folder that exist; Parquet is preferred to CSV."""
    if not path_exists(spark, folder):
        raise FileNotFoundError(folder)
    found: dict[str, DataFrame] = {}
    for name in RESULT_TABLES:
        base = f"{folder.rstrip('/')}/{name}"
        try:
            if path_exists(spark, base):
                found[name] = spark.read.parquet(base)
            elif path_exists(spark, base + ".csv"):
                found[name] = spark.read.csv(base + ".csv", header=True)
        except AnalysisException:  # a file without any column: an empty table
            found[name] = spark.createDataFrame([], "status string")
    return found


def read_spectra(spark: SparkSession, folder: str, population_a: str | None = None, population_b: str | None = None) -> DataFrame:
    """Saved spectrum cells; naming a population reads only the files whose ranges hold it."""
    cells = spark.read.parquet(folder)
    if population_a is not None:
        cells = cells.filter(F.col("population_a") == population_a)
    if population_b is not None:
        cells = cells.filter(F.col("population_b") == population_b)
    return cells
