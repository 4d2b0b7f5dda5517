"""Block-gzipped text, read by many tasks.

A block-gzipped file is a row of gzip members of up to 64 KB, each with its size in its
header, so members can be found without decompressing what lies before. Byte ranges are
dealt over tasks; a task starts at the first member of its range, which it recognises by
the fixed fields of a header and by the header that must follow, and goes on past the end
of its range until its last line is whole.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilane.sources.ranges import RANGE, Piece, list_files, open_file, over_ranges, whole_lines

# Fixed values of the format: gzip magic with an extra field; the field's name and length;
# the empty member that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
SIZE_FIELD = b"BC\x02\x00"
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEADER, FOOTER = 18, 8
LARGEST = 1 << 16
MEMBER_TEXT = 0xFF00


def member_size(data: bytes, at: int) -> int | None:
    """Size of the member whose header stands at ``at``; None if no header is there."""
    head = data[at : at + HEADER]
    if len(head) < HEADER or head[:4] != MAGIC or head[12:16] != SIZE_FIELD:
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


class _Window:
    """Bytes of a file from ``start`` on, read further as needed."""

    def __init__(self, source, start: int, stop: int):
        self.source, self.start, self.size = source, start, source.size()
        self.data = b""
        self.reach(stop)

    def reach(self, stop: int) -> None:
        stop = min(stop, self.size)
        held = self.start + len(self.data)
        if stop > held:
            self.data += self.source.read_at(stop - held, held)

    def size_at(self, place: int) -> int | None:
        self.reach(place + HEADER)
        return member_size(self.data, place - self.start)

    def first(self, stop: int) -> int | None:
        """The first member that starts before ``stop``."""
        at = self.start
        while True:
            found = self.data.find(MAGIC, at - self.start)
            if found < 0 or self.start + found >= stop:
                return None
            at = self.start + found
            size = self.size_at(at)
            if size and (at + size == self.size or self.size_at(at + size)):
                return at
            at += 1

    def members(self, place: int | None, stop: int):
        """Place and size of the members from ``place`` that start before ``stop``."""
        while place is not None and place < min(stop, self.size):
            size = self.size_at(place)
            if size is None:
                raise ValueError(f"no member of a block-gzipped file at byte {place}")
            yield place, size
            place += size

    def text(self, place: int, size: int) -> bytes:
        self.reach(place + size)
        return gzip.decompress(self.data[place - self.start : place - self.start + size])


def is_block_gzip(uri: str) -> bool:
    """Whether a file starts with a member of known size; False where Arrow cannot open it."""
    try:
        with open_file(uri) as source:
            return member_size(source.read_at(min(HEADER, source.size()), 0), 0) is not None
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False


def _window(source, piece: Piece) -> tuple[_Window, int | None]:
    """The bytes of a range, and its first member."""
    # A header may start at the last byte of the range.
    window = _Window(source, piece.start, piece.stop + HEADER)
    # Whether the members of a range end where those of the next one start shows when
    # its last line is read to its end.
    return window, window.first(piece.stop) if piece.start else 0


def member_index(spark: SparkSession, path, range_bytes: int = RANGE) -> DataFrame:
    """``file,offset,size,text_size`` of every member."""

    def work(piece):
        with open_file(piece.file) as source:
            window, first = _window(source, piece)
            found = list(window.members(first, piece.stop))
            sizes = []
            for at, size in found:
                window.reach(at + size)
                sizes.append(struct.unpack_from("<I", window.data, at + size - 4 - window.start)[0])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([piece.file] * len(found), pa.string()),
                pa.array([at for at, _ in found], pa.int64()),
                pa.array([size for _, size in found], pa.int64()),
                pa.array(sizes, pa.int64()),
            ],
            names=["file", "offset", "size", "text_size"],
        )

    schema = "file string, offset long, size long, text_size long"
    return over_ranges(spark, list_files(spark, path), work, schema, range_bytes)


def block_lines(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE) -> DataFrame:
    """``line_no,value,file`` of block-gzipped files. ``line_no`` grows along the files, with
    gaps between ranges."""

    def work(piece):
        with open_file(piece.file) as source:
            window, first = _window(source, piece)
            if first is None:
                return
            own = list(window.members(first, piece.stop))
            head = b"".join(window.text(*m) for m in own)
            later = (window.text(*m) for m in window.members(sum(own[-1]), window.size))
            _, text = whole_lines(head, later, piece.start == 0)
        lines = text.splitlines()
        for at in range(0, len(lines), 1 << 16):
            part = lines[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(piece.number << 32) + at + k for k in range(len(part))], pa.int64()),
                    pa.array(part, pa.binary()),
                    pa.array([piece.file] * len(part), pa.string()),
                ],
                names=["line_no", "value", "file"],
            )

    read = over_ranges(spark, files, work, "line_no long, value binary, file string", range_bytes)
    return read.withColumn("value", F.col("value").cast("string"))


def pack_member(text: bytes) -> bytes:
    """One member of up to ``MEMBER_TEXT`` bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    size = HEADER + len(body) + FOOTER
    if size > LARGEST:  # text that does not shrink is stored
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(text) + packer.flush()
        size = HEADER + len(body) + FOOTER
    head = MAGIC + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + SIZE_FIELD + struct.pack("<H", size - 1)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def pack_members(text: bytes) -> bytes:
    return b"".join(pack_member(text[at : at + MEMBER_TEXT]) for at in range(0, len(text), MEMBER_TEXT))
