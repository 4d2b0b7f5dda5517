"""Byte ranges of files, dealt over tasks.

For formats that Spark's own readers cannot split or seek in. Files are listed through
Spark's file system; tasks open them with Arrow's, so the store must be one that both know.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

RANGE = 16 << 20
MOST_TASKS = 20_000


def list_files(spark: SparkSession, path) -> list[tuple[str, int]]:
    """Name with scheme and size of all files of a path, folder, pattern or list of them,
    in order of names; hidden files are left out."""
    found = {}
    for one in [path] if isinstance(path, str) else list(path):
        place = spark._jvm.org.apache.hadoop.fs.Path(one)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        matched = system.globStatus(place)
        if not matched:
            raise FileNotFoundError(one)
        for status in matched:
            for held in system.listStatus(status.getPath()) if status.isDirectory() else [status]:
                name = held.getPath().getName()
                if not held.isDirectory() and not name.startswith(("_", ".")):
                    uri = held.getPath().toString()
                    if uri.startswith("file:/") and not uri.startswith("file:///"):
                        uri = "file:///" + uri[len("file:/") :].lstrip("/")
                    found[uri] = held.getLen()
    return sorted(found.items())


def open_file(uri: str):
    """A seekable file of any store that Arrow knows."""
    system, place = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(place)


class Piece(NamedTuple):
    """A byte range of a file; ``number`` counts the ranges of all files in order."""

    file: str
    number: int
    start: int
    stop: int


def over_ranges(
    spark: SparkSession,
    files: list[tuple[str, int]],
    work: Callable[[Piece], Iterator[pa.RecordBatch]],
    schema: str,
    range_bytes: int = RANGE,
) -> DataFrame:
    """What ``work`` gives for each range; up to ``MOST_TASKS`` ranges are a task each."""
    counts = [-(-size // range_bytes) for _, size in files]
    firsts = list(accumulate([0, *counts]))

    def run(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                at = bisect_right(firsts, number) - 1
                uri, size = files[at]
                start = (number - firsts[at]) * range_bytes
                yield from work(Piece(uri, number, start, min(start + range_bytes, size)))

    total = firsts[-1]
    return spark.range(0, total, 1, max(min(total, MOST_TASKS), 1)).mapInArrow(run, schema)


def first_break(data: bytes, start: int) -> tuple[int, int] | None:
    """Place and end of the first line break from ``start`` on: LF, CR or both."""
    line, carriage = data.find(b"\n", start), data.find(b"\r", start)
    if line < 0 and carriage < 0:
        return None
    if carriage < 0 or 0 <= line < carriage:
        return line, line + 1
    return carriage, carriage + 1 + (data[carriage + 1 : carriage + 2] == b"\n")


def whole_lines(head: bytes, later: Iterator[bytes], is_first: bool) -> tuple[int, bytes]:
    """The lines that belong to a range: those that start after its first byte (in the
    first range of a file: at it) and not after its end.

    ``head`` is the range's text, ``later`` gives what follows, as far as needed. Returns
    where the lines start in the text, and the lines with their breaks.
    """
    data = head

    def seek(start):
        nonlocal data
        while True:
            found = first_break(data, start)
            # A carriage return at the end of what is known may go on.
            if found and (found[1] < len(data) or data[found[0] : found[0] + 1] == b"\n"):
                return found[1]
            more = next(later, None)
            if more is None:
                return found[1] if found else len(data)
            data += more

    start = 0 if is_first else seek(0)
    stop = seek(len(head))
    return start, data[start:stop] if stop > start else b""
