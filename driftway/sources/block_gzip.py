"""Text in block gzip files, read by many tasks a file.

A block gzip file is a row of small gzip members; each tells its own length in its header, so reading can begin at any
member. A file is cut into ranges of compressed bytes. One pass over the ranges finds the first member of each and adds up
the lengths of its text from the members' ends, without inflating anything; so each range knows where its text begins. The
second pass inflates. A line belongs to the range that its first byte lies in, and is read on past the end of the range.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 32 << 20
# Compressed bytes of a task where ranges are smaller; it takes neighbouring ranges.
_TASK_BYTES = 4 << 20
# Text of a written block, below the 64 KiB that a block may hold.
BLOCK_TEXT = 65_280
_MOST = 1 << 16
_MAGIC = b"\x1f\x8b\x08\x04"
_LINES_PER_BATCH = 20_000


def member_size(data: bytes, at: int = 0) -> int | None:
    """The whole length of the block that begins at ``at``, or None where no block header is."""
    if data[at : at + 4] != _MAGIC or len(data) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    place, end = at + 12, at + 12 + extra
    while place + 4 <= min(end, len(data)):
        kind, length = data[place : place + 2], struct.unpack_from("<H", data, place + 2)[0]
        if kind == b"BC" and length == 2 and place + 6 <= len(data):
            return struct.unpack_from("<H", data, place + 4)[0] + 1
        place += 4 + length
    return None


def blocked(text: Iterator[bytes], size: int = BLOCK_TEXT) -> Iterator[bytes]:
    """The blocks of a file with the given pieces of text, the empty last one included."""
    held = b""
    for piece in text:
        held += piece
        while len(held) >= size:
            yield _block(held[:size])
            held = held[size:]
    if held:
        yield _block(held)
    yield _block(b"")


def _block(text: bytes) -> bytes:
    for level in (6, 0):  # text that does not shrink is stored
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(text) + packer.flush()
        if len(body) + 26 <= _MOST:
            break
    head = _MAGIC + bytes(5) + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


class _Range:
    """Compressed bytes from a place of a file on, a megabyte at a time, or less for a short range."""

    def __init__(self, stream, start: int, end: int):
        stream.seek(start)
        self.stream, self.data, self.base, self.at = stream, b"", start, 0
        self.piece = max(_MOST, min(1 << 20, end - start))

    def more(self) -> bool:
        data = self.stream.read(self.piece)
        self.data = self.data[self.at :] + data
        self.base += self.at
        self.at = 0
        return bool(data)

    def has(self, size: int) -> bool:
        while len(self.data) - self.at < size:
            if not self.more():
                return False
        return True

    def first_member(self, end: int) -> int | None:
        """The place of the first block before ``end``: a header that leads to another one, or to the end of the file."""
        while True:
            self.has(3 * _MOST)
            found = self.data.find(_MAGIC, self.at)
            if found < 0:
                self.at = max(self.at, len(self.data) - len(_MAGIC) + 1)
                if self.base + self.at >= end or not self.more():
                    return None
                continue
            self.at = found
            if self.base + found >= end:
                return None
            self.has(3 * _MOST)
            size = member_size(self.data, self.at)
            if size is not None and (self.at + size == len(self.data) or member_size(self.data, self.at + size) is not None):
                return self.base + self.at
            self.at += 1

    def members(self) -> Iterator[tuple[int, bytes]]:
        """(place, block) of all blocks from here to the end of the file."""
        while self.has(18):
            size = member_size(self.data, self.at)
            if size is None or not self.has(size):
                raise ValueError(f"there is no whole block at byte {self.base + self.at}.")
            yield self.base + self.at, self.data[self.at : self.at + size]
            self.at += size
        if self.at < len(self.data):
            raise ValueError(f"the file breaks off at byte {self.base + len(self.data)}.")


def _opened(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Each row, its file's name first, with the open file; it stays open over the rows that follow with the same name."""
    from pyarrow import fs

    last, stream = None, None
    try:
        for row in rows:
            if row[0] != last:
                if stream is not None:
                    stream.close()
                system, location = fs.FileSystem.from_uri(row[0])
                last, stream = row[0], system.open_input_file(location)
            yield row, stream
    finally:
        if stream is not None:
            stream.close()


def block_gzip_files(spark: SparkSession, files: list[str]) -> list[tuple[str, int]]:
    """(file, size) of the files that begin with a block header; tasks look at the first bytes of each."""

    def look(batches):
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name in batch["file"]:
                system, location = fs.FileSystem.from_uri(name)
                with system.open_input_file(location) as stream:
                    size = stream.size()
                    rows.append((name, size if member_size(stream.read(min(size, 4096))) is not None else None))
            yield pd.DataFrame(rows, columns=["file", "size"]).astype({"size": "Int64"})

    if not files:
        return []
    listing = spark.createDataFrame([(name,) for name in files], "file string").repartition(max(1, min(len(files), 1024)), "file")
    found = listing.mapInPandas(look, "file string, size long").filter("size IS NOT NULL")
    return sorted((r["file"], r["size"]) for r in found.collect())  # a row per file


def read_block_gzip(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of block gzip files: value, file_path and line_in_file (the place of the line's first byte in the text).

    ``files`` has (file, size). Line ends are ``\\n`` or ``\\r\\n``; the last line needs none. A file that breaks off
    inside a block, or does not match its checksums, is an error.
    """
    if range_bytes < 1:
        raise ValueError("a range needs at least one byte.")
    ranges = [(name, start, min(start + range_bytes, size)) for name, size in files for start in range(0, size, range_bytes)]
    schema = "file string, start long, end long"

    def measure(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for (name, start, end), stream in _opened(zip(batch["file"], batch["start"], batch["end"])):
                part = _Range(stream, start, end)
                first, text = part.first_member(end), 0
                if first is not None:
                    for place, block in part.members():
                        if place >= end:
                            break
                        text += struct.unpack("<I", block[-4:])[0]
                rows.append((name, start, end, first, text))
            out = pd.DataFrame(rows, columns=["file", "start", "end", "first", "text"])
            yield out.astype({"first": "Int64"})

    # a range of the usual size is a task of its own; of shorter ones, neighbours share a task
    enough = max(2 * spark.sparkContext.defaultParallelism, sum(end - start for _, start, end in ranges) // _TASK_BYTES)

    def dealt(rows, kinds):
        parts = max(1, min(len(rows), 10_000, enough))
        numbered = [(k * parts // len(rows), *row) for k, row in enumerate(rows)]
        return spark.createDataFrame(numbered, f"number int, {kinds}").repartitionById(parts, F.col("number")).drop("number")

    if not ranges:
        return spark.createDataFrame([], "value string, file_path string, line_in_file long")
    planned = dealt(ranges, schema)
    # a row per range: its first block, and where its text begins
    found = sorted(map(tuple, planned.mapInPandas(measure, f"{schema}, first long, text long").collect()))
    rows, before, last = [], 0, None
    for name, start, end, first, text in found:
        before = before if name == last else 0
        if first is not None:
            rows.append((name, start == 0, end, first, before))
        before, last = before + text, name

    def lines(batches):
        for batch in batches:
            listed = zip(*(column.to_pylist() for column in batch.columns))
            for (name, opens, end, first, before), stream in _opened(listed):
                values, places = [], []
                for place, line in _owned(_Range(stream, first, end), opens, end, before):
                    values.append(line)
                    places.append(place)
                    if len(values) == _LINES_PER_BATCH:
                        yield made(values, places, name)
                        values, places = [], []
                if values:
                    yield made(values, places, name)

    def made(values, places, name):
        import pyarrow as pa

        text = pa.array([v.decode("utf-8", "replace") for v in values], pa.string())
        return pa.RecordBatch.from_arrays([text, pa.array([name] * len(values)), pa.array(places, pa.int64())], names=["value", "file_path", "line_in_file"])

    if not rows:
        return spark.createDataFrame([], "value string, file_path string, line_in_file long")
    kinds = "file string, opens boolean, end long, first long, before long"
    return dealt(rows, kinds).mapInArrow(lines, "value string, file_path string, line_in_file long")


def _owned(part: _Range, opens: bool, end: int, before: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines whose first byte lies in a range: of all but a file's first range, from its first line end on.

    A line that begins where the range ends is read here, as the next range drops all up to its first line end.
    """
    held, start, dropping, over = b"", before, not opens, False
    for place, block in part.members():
        if place >= end and not over:
            over = True
            if dropping:
                return  # no line ends in this range: an earlier one reads on through it
        held += zlib.decompress(block, 31)
        if dropping:
            cut = held.find(b"\n") + 1
            if not cut:
                start += len(held)
                held = b""
                continue
            held, start, dropping = held[cut:], start + cut, False
        *whole, rest = held.split(b"\n")
        for line in whole:
            yield start, line[:-1] if line.endswith(b"\r") else line
            start += len(line) + 1
            if over:
                return  # the line that was open where the range ended
        held = rest
    if held and not dropping:
        yield start, held[:-1] if held.endswith(b"\r") else held


def write_block_gzip(lines: DataFrame, folder: str, header: list[str] | None = None, block_text: int = BLOCK_TEXT) -> list[str]:
    """Writes the column ``value`` as block gzip text, a file per partition, each with the header lines first.

    Files have names of their own, and only those of finished tasks are returned, so a repeated task does no harm.
    """

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.vcf.gz"

        def text():
            if header:
                yield ("\n".join(header) + "\n").encode()
            for batch in batches:
                if batch.num_rows:
                    yield ("\n".join(batch.column(0).to_pylist()) + "\n").encode()

        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for block in blocked(text(), block_text):
                out.write(block)
        yield pa.RecordBatch.from_pydict({"file": [f"{folder.rstrip('/')}/{name}"]})

    return sorted(r["file"] for r in lines.select("value").mapInArrow(write, "file string").collect())
