"""WARC archives: write with an index, then read selected records by coalesced ranges.

Writing deduplicates payloads: of records with equal payloads the one with the largest
key is a response, the others are revisits that refer to it. The index has one row per
record (file, offset, length, URL, digest). Reading takes any selection of index rows,
sorts them by place and fetches neighbouring records with one read.

Cases: a null payload is an empty one; a null URL leaves the header out; among equal
payloads a null key is a revisit of the largest key, and a response if all are null;
repeated rows with the largest key are all responses; other columns are not read; an
empty table gives an empty index. A task that is run again writes new files, and the
index names only those of the attempt that counted.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilane.session import Scratch

URN = "urn:epilane:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = (
    "page_id long, url string, digest string, record_type string, refers_to long,"
    " file string, offset long, length long"
)
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long, payload binary"
)
ARROW_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [() for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, ARROW_TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields],
    )


def _urn(key: int | None) -> str:
    return f"<{URN}{'none' if key is None else key}>"


def _key(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(URN)
    return int(text) if re.fullmatch(r"-?[0-9]+", text) else None


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(key, url, payload: bytes, digest: str, refers, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(key)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", _percent, url))
    if refers is not None:
        head += [f"WARC-Refers-To: {_urn(refers)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _percent(match: re.Match) -> str:
    return "".join(f"%{b:02X}" for b in match.group().encode())


def _parse(raw: bytes) -> tuple:
    """A record's row; the digest of a response is worked out from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: ([0-9]+)", http).group(1))
    kind = fields["WARC-Type"]
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or _digest(payload) != stated):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return (
        _key(fields["WARC-Record-ID"]),
        fields.get("WARC-Target-URI"),
        size,
        stated,
        kind,
        _key(fields.get("WARC-Refers-To")),
        payload if kind == "response" else None,
    )


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    max_file_bytes: int = 1 << 30,
    gzip_level: int = 4,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write every row as a gzip member of an archive in ``folder``; return the index.

    The frame writes when it runs: store it (as the index) before reading records.
    Payloads shorter than ``min_revisit_bytes`` are always responses.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    shared = (
        rows.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("sha")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("sha", "refers_to")
    )
    later = F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))
    rows = rows.join(shared, "sha", "left").select(
        "page_id", "url", "payload", F.when(later, F.col("refers_to")).alias("refers_to")
    )

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                index = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key, url, payload, refers = row
                    if out is None or at >= max_file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    digest = _digest(payload)
                    pack = zlib.compressobj(gzip_level, zlib.DEFLATED, 31)
                    member = pack.compress(_record(key, url, payload, digest, refers, date))
                    member += pack.flush()
                    out.write(member)
                    kind = "response" if refers is None else "revisit"
                    index.append((key, url, digest, kind, refers, name, at, len(member)))
                    at += len(member)
                yield _batch(INDEX_SCHEMA, index)
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(write, INDEX_SCHEMA)


def read_warc(
    index: DataFrame,
    folder: str,
    range_bytes: int = 8 << 20,
    max_gap: int = 64 << 10,
    payloads: bool = True,
) -> DataFrame:
    """The records that ``index`` selects, parsed from the archives in ``folder``.

    Selected records within ``range_bytes`` of a file come to one task in order of
    place; those less than ``max_gap`` bytes apart are fetched with one read.
    """
    stretch = F.floor(F.col("offset") / range_bytes)
    # By bytes of the archives, which the few bytes of an index row do not show.
    volume = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    wanted = (
        index.select("file", "offset", "length")
        .repartition(max(volume >> 25, min(cores, volume >> 20), 1), "file", stretch)
        .sortWithinPartitions("file", "offset")
    )

    def fetch(fs, root, name, places):
        start, end = places[0][0], max(at + size for at, size in places)
        with fs.open_input_file(f"{root}/{name}") as source:
            source.seek(start)
            data = source.read(end - start)
        rows = []
        for at, size in places:
            row = _parse(zlib.decompress(data[at - start : at - start + size], 31))
            rows.append(row if payloads else (*row[:-1], None))
        return _batch(RECORD_SCHEMA, rows)

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        name, places, end = None, [], 0
        for batch in batches:
            for file, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                apart = file != name or at > end + max_gap
                if places and (apart or at - places[0][0] >= range_bytes):
                    yield fetch(fs, root, name, places)
                    places = []
                name, end = file, at + size
                places.append((at, size))
        if places:
            yield fetch(fs, root, name, places)

    return wanted.mapInArrow(read, RECORD_SCHEMA)


def op1_warc(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    with Scratch(spark) as scratch:
        archives = f"{scratch.path}/archives"
        index = scratch.table(write_warc(pages, archives), "index")
        return scratch.result(read_warc(index, archives, payloads=False).drop("payload", "url"))
