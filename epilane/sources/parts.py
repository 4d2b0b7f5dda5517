"""Text in one global order, written by many tasks.

Rows are dealt in ranges of their keys, so a hot chromosome is split wherever its
positions differ. Every range becomes a part file, block-gzipped if the path ends in
``.gz``; parts one after the other in order of their names are the whole text under one
header. A manifest beside them lists the parts with their first and last keys, and only
files of attempts that counted are given their names.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilane.operators.ordered import running
from epilane.sources.blocks import LAST, MEMBER_TEXT, pack_members
from epilane.sources.lines import line_tile, numbered_lines

MANIFEST = "_manifest"
WRITTEN = "_written"


class _Part:
    """A part file under a name of its attempt."""

    def __init__(self, folder: str, number: int, packed: bool):
        self.system, place = pafs.FileSystem.from_uri(folder)
        self.system.create_dir(place, recursive=True)
        self.name = f"{number:05d}-{uuid.uuid4().hex}"
        self.sink = self.system.open_output_stream(f"{place}/{self.name}")
        self.packed, self.held, self.lines, self.bytes = packed, bytearray(), 0, 0

    def write(self, lines: list[str]) -> None:
        for line in lines:
            self.held += line.encode() + b"\n"
        self.lines += len(lines)
        if self.packed:
            whole = len(self.held) // MEMBER_TEXT * MEMBER_TEXT
            self._put(pack_members(bytes(self.held[:whole])))
            del self.held[:whole]
        else:
            self._put(bytes(self.held))
            self.held.clear()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.packed:
            self._put(pack_members(bytes(self.held)) + LAST)
        self.sink.close()


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, re.sub("^file:/+", "file:///", system.makeQualified(place).toString())


def write_ordered(rows: DataFrame, keys: list[str], path: str, header: str | None = None) -> DataFrame:
    """Write the ``value`` lines of ``rows`` in global order of ``keys``; the folder must not
    exist. Returns the manifest: ``part,file,lines,bytes,first,last``, ``first`` and
    ``last`` with the keys of a part's ends (null for the header's own part)."""
    spark = rows.sparkSession
    system, folder = _place(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if system.exists(hadoop(folder)):
        raise FileExistsError(path)
    system.mkdirs(hadoop(f"{folder}/{WRITTEN}"))
    packed = path.endswith(".gz")
    ends = rows.select(F.struct(*keys).alias("first")).schema[0].dataType
    schema = f"part int, file string, lines long, bytes long, first {ends.simpleString()}, last {ends.simpleString()}"

    def run(batches):
        part, first, last = None, None, None
        number = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            part = part or _Part(f"{folder}/{WRITTEN}", number, packed)
            part.write(batch.column(0).to_pylist())
            found = batch.column(1)
            first = found.slice(0, 1) if first is None else first
            last = found.slice(batch.num_rows - 1, 1)
        if part:
            part.close()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int32()),
                    pa.array([part.name]),
                    pa.array([part.lines], pa.int64()),
                    pa.array([part.bytes], pa.int64()),
                    first,
                    last,
                ],
                names=["part", "file", "lines", "bytes", "first", "last"],
            )

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = ordered.select("value", F.struct(*keys).alias("k")).mapInArrow(run, schema).collect()
    listed = []
    if header is not None:
        head = _Part(f"{folder}/{WRITTEN}", 0, packed)
        head.write(header.split("\n"))
        head.close()
        listed.append((head.name, head.lines, head.bytes, None, None))
    # One row a part; names follow the order.
    listed += [(r["file"], r["lines"], r["bytes"], r["first"], r["last"]) for r in sorted(written, key=lambda r: r["part"])]
    rows_ = []
    for k, (name, *rest) in enumerate(listed):
        final = f"part-{k:05d}{'.gz' if packed else ''}"
        if not system.rename(hadoop(f"{folder}/{WRITTEN}/{name}"), hadoop(f"{folder}/{final}")):
            raise OSError(f"cannot name part {k} of {path}")
        rows_.append((k, final, *rest))
    system.delete(hadoop(f"{folder}/{WRITTEN}"), True)
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{folder}/{MANIFEST}")
    return spark.read.schema(schema).parquet(f"{folder}/{MANIFEST}")


def check_order(spark: SparkSession, path: str) -> int:
    """The number of parts with rows; fails where a part starts before the last one ended."""
    rows = spark.read.parquet(f"{path}/{MANIFEST}").filter("first is not null").orderBy("part").collect()
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if tuple(a["last"]) > tuple(b["first"]):
            raise ValueError(f"part {b['file']} starts before the end of {a['file']}")
    return len(rows)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """``place,line``: the lines of an ordered text without its header, numbered from 0 in
    the order of the whole."""
    manifest = spark.read.parquet(f"{path}/{MANIFEST}").filter("first is not null")
    parts = manifest.orderBy("part").select("file", "lines").collect()
    base, starts = 0, []
    for r in parts:
        starts.append((r["file"], base))
        base += r["lines"]
    if not starts:
        return spark.createDataFrame([], "place long, line string")
    files = [f"{path.rstrip('/')}/{name}" for name, _ in starts]
    lines = numbered_lines(spark, files)
    seen = running(lines, ["file"], ["line_no"], {"seen": ("sum", F.lit(1))}, line_tile())
    table = F.broadcast(spark.createDataFrame(starts, "name string, base long"))  # one row a part
    named = seen.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(table, "name")
    return named.select((F.col("base") + F.col("seen") - 1).cast("long").alias("place"), "line")
