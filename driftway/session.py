"""Session defaults and the few physical-plan helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is no longer broadcast.
BROADCAST_ROWS = 1_000_000
# Bytes it may have, as estimated from its types.
BROADCAST_BYTES = 128 << 20

_LOCAL: dict[str, str] = {}


def build_session(app: str = "driftway", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def _row_bytes(df: DataFrame) -> int:
    """A rough width of a row: numbers 8 bytes, texts 40, nested values 200."""
    widths = {"string": 40, "binary": 200, "array": 200, "map": 200, "struct": 200}
    return 16 + sum(widths.get(f.dataType.typeName(), 8) for f in df.schema)


def fits_in_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows of together about ``BROADCAST_BYTES`` at most."""
    return df.count() <= min(max_rows, BROADCAST_BYTES // _row_bytes(df))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when its counted size allows it; else leave the join to shuffle."""
    return F.broadcast(df) if fits_in_broadcast(df, max_rows) else df


def parts_of(rows: int, each: int) -> int:
    """Partitions for so many rows with about ``each`` in one; 20,000 at most."""
    return max(1, min(20_000, -(-rows // each)))


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share.")
        base = _LOCAL.get("folder") or _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so that several branches share it and the plan ends there.

    Without a folder the table goes below ``spark.checkpoint.dir``, the shared
    folder a cluster names. Only a local session may fall back to a temporary one.
    """
    spark = df.sparkSession
    folder = folder or work_folder(spark, "driftway")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this run made; nothing happens where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
