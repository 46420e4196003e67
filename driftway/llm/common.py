"""What the corpus operators share: reading, work folders, splitting by key, and small text helpers."""

from __future__ import annotations

import bisect
import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes to lower-case words in UTF-8: A-Z become a-z; NUL to slash, colon to grave (after lower-casing) and
#: brace to DEL become spaces, so that split() gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
_WORD_BYTES = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

_FALLBACK: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession) -> None:
    """Give Python workers the package where they can't import it from their own path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if root in paths or _SHIPPED.get("to") == context.applicationId:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "driftway_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "driftway")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _SHIPPED["to"] = context.applicationId


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a local session without one (as in tests) takes a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share.")
        base = _FALLBACK.setdefault("base", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read again: shared by several readers, and the lineage ends there."""
    folder = work_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def held_out(doc_id) -> F.Column:
    """True for rows of the held-out quarter: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


def lower_words(text: str | None) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A-Z lower-cased, as UTF-8; none for null."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8; none for null."""
    return text.encode().translate(_LOWER).split() if text else []  # bytes.split() knows just these six blanks


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python holds few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def give_back() -> None:
    """Return freed memory of a worker to the system. Workers live on from stage to stage, and what one stage has freed is
    otherwise counted on top of what the next one takes."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(batch) -> {column: values}`` over small Arrow batches of ``df``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in slices(batches):
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, type=arrow_type(schema, n)) for n, v in ((n, out[n]) for n in names)],
                    names=names,
                )
        give_back()

    shipped(df.sparkSession)
    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_type(schema: str, name: str) -> pa.DataType:
    return _ARROW[dict(part.split() for part in schema.split(", "))[name]]


def cut_points(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 rising values that split the rows of ``df`` about evenly by a long ``key``."""
    if parts < 2:
        return []
    probabilities = [k / parts for k in range(1, parts)]
    found = df.approxQuantile(key, probabilities, 1 / (8 * parts))
    return sorted({int(v) for v in found})


def part_of(key: F.Column, cuts: list[int]) -> F.Column:
    """The number of cut points at or below ``key``: the index of its range. Null goes to the last range."""
    if not cuts:
        return F.lit(0)

    def between(low: int, high: int) -> F.Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < cuts[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(cuts))


def default_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def locate(cuts: list[int], value: int) -> int:
    return bisect.bisect_right(cuts, value)


def keep_batches(df: DataFrame, column: str, fn: Callable) -> DataFrame:
    """The rows for which ``fn(values of column)`` says True, with all their columns, in one pass without a join."""
    position = df.columns.index(column)

    def run(batches):
        for batch in slices(batches):
            if batch.num_rows:
                yield batch.filter(pa.array(fn(batch.column(position).to_pylist()), pa.bool_()))
        give_back()

    shipped(df.sparkSession)
    return df.mapInArrow(run, df.schema)
