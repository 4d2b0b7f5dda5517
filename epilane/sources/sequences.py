"""FASTA and FASTQ text as tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilane.operators.intervals import CHUNK, overlap_join
from epilane.operators.ordered import running
from epilane.sources.lines import line_tile, numbered_lines
from epilane.sources.ranges import RANGE, list_files, open_file, over_ranges, whole_lines

# Bytes that several segments are read in at once.
MOST_READ = 8 << 20

# How the header of a later piece of a sequence ends.
PIECE = r" offset=(\d+)$"


def read_fasta(
    spark: SparkSession, path, name: str = "token", chunk_size: int = CHUNK, pieces: bool = False
) -> DataFrame:
    """``chrom,chunk_no,offset,seq``: chunks of ``chunk_size`` bases.

    ``name='token'`` takes the header up to the first blank, ``'line'`` all of it.
    Headers and offsets are carried along the lines, so no row ever holds a sequence.
    ``pieces`` reads the parts that ``sinks.write_fasta`` writes: a header with
    ``offset=N`` goes on with a sequence at that base, in whatever file it began.
    """
    if name not in ("token", "line"):
        raise ValueError("name must be 'token' or 'line'")
    lines = numbered_lines(spark, path)
    is_header = F.startswith("line", F.lit(">"))
    size = F.when(is_header, 0).otherwise(F.length("line")).cast("bigint")
    title = F.substr(F.col("line"), F.lit(2))
    begins = F.lit(0).cast("bigint")
    if pieces:
        begins = F.coalesce(F.regexp_extract("line", PIECE, 1).try_cast("bigint"), begins)
        title = F.regexp_replace(title, PIECE, "")
    if name == "token":
        title = F.split(title, r"\s+")[0]
    summed = running(
        lines, ["file"], ["line_no"], {"end_at": ("sum", size)}, line_tile()
    )
    named = running(
        summed,
        ["file"],
        ["line_no"],
        {
            "head": (
                "max",
                F.when(is_header, F.struct("line_no", title.alias("name"), (F.col("end_at") - begins).alias("base"))),
            )
        },
        line_tile(),
    )
    text = named.filter(~is_header & (F.col("line") != "")).select(
        F.col("head.name").alias("chrom"),
        (F.col("end_at") - F.length("line") - F.col("head.base")).alias("at"),
        "line",
    )
    last = F.col("at") + F.length("line") - 1
    pieces = text.withColumn(
        "chunk_no",
        F.explode(F.sequence(F.floor(F.col("at") / chunk_size), F.floor(last / chunk_size))),
    )
    begin = F.greatest(F.col("at"), F.col("chunk_no") * chunk_size)
    stop = F.least(last + 1, (F.col("chunk_no") + 1) * chunk_size)
    cut = pieces.select(
        "chrom",
        "chunk_no",
        begin.alias("begin"),
        F.substring(
            F.col("line"), (begin - F.col("at") + 1).cast("int"), (stop - begin).cast("int")
        ).alias("piece"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("begin", "piece")))
    return cut.groupBy("chrom", "chunk_no").agg(
        (F.col("chunk_no") * chunk_size).alias("offset"),
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("seq"),
    )


def read_fastq(spark: SparkSession, path, places: bool = False) -> DataFrame:
    """``name,seq,qual`` of four-line records. A gzip file is one split.

    ``places`` adds ``file`` and ``record``, the number of the record in its file.
    """
    lines = numbered_lines(spark, path)
    counted = running(
        lines, ["file"], ["line_no"], {"seen": ("sum", F.lit(1))}, line_tile()
    ).withColumn("at", F.col("seen") - 1)
    part = F.col("at") % 4

    def pick(i):
        return F.max(F.when(part == i, F.col("line")))

    where = ["file", "record"] if places else []
    return (
        counted.groupBy("file", F.floor(F.col("at") / 4).alias("record"))
        .agg(pick(0).alias("head"), pick(1).alias("seq"), pick(3).alias("qual"))
        .select(F.substr(F.col("head"), F.lit(2)).alias("name"), "seq", "qual", *where)
    )


def fasta_index(
    spark: SparkSession, path, pieces: bool = False, range_bytes: int = RANGE
) -> DataFrame:
    """``chrom,base,length,file,start,line_bases,line_bytes`` of every sequence, or with
    ``pieces`` every piece of one, of uncompressed FASTA files: the offset of its first
    base, its bases, the byte of the first, and the size of a line without and with its
    break. Written as a table it serves any number of later reads.

    Files are scanned in byte ranges by a task each; a range gives one row for each header
    in it and one for the lines before the first. Sequences whose lines differ in size,
    but for the last, fail: no byte can be worked out for them.
    """

    def work(piece):
        with open_file(piece.file) as source:
            head = source.read_at(piece.stop - piece.start, piece.start)
            places = range(piece.stop, source.size(), 1 << 16)
            later = (source.read_at(min(1 << 16, source.size() - at), at) for at in places)
            skipped, text = whole_lines(head, later, piece.start == 0)
        rows, at = [], piece.start + skipped
        row = {"at": at, "title": None, "start": at, "base": 0, "n": 0, "bases": 0, "most": 0, "first": 0, "first_bytes": 0, "last": 0}
        for line in text.splitlines(keepends=True):
            bare = line.rstrip(b"\r\n")
            if bare.startswith(b">"):
                rows.append(row)
                title = (bare[1:].split() or [b""])[0].decode("utf-8", "replace")
                goes_on = re.search(PIECE.encode(), bare) if pieces else None
                row = dict.fromkeys(row, 0) | {"at": at, "title": title, "start": at + len(line)}
                row["base"] = int(goes_on[1]) if goes_on else 0
            elif bare:
                if row["n"] == 0:
                    row |= {"first": len(bare), "first_bytes": len(line)}
                row["n"] += 1
                row["bases"] += len(bare)
                row["most"] = max(row["most"], len(bare))
                row["last"] = len(bare)
            at += len(line)
        rows.append(row)
        yield pa.RecordBatch.from_pylist([{"file": piece.file, **r} for r in rows], schema=schema)

    schema = pa.schema(
        [("file", pa.string()), ("at", pa.int64()), ("title", pa.string())]
        + [(c, pa.int64()) for c in ("start", "base", "n", "bases", "most", "first", "first_bytes", "last")]
    )
    kinds = ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in schema)
    stretches = over_ranges(spark, list_files(spark, path), work, kinds, range_bytes)
    # A row follows each header and each range: few, so a running maximum over tiles of
    # bytes carries the last header to the ranges that go on with its sequence.
    titled = running(
        stretches,
        ["file"],
        ["at"],
        {"head": ("max", F.when(F.col("title").isNotNull(), F.struct("at", "title", "start", "base")))},
        F.floor(F.col("at") / (range_bytes * 64)),
    ).filter("head is not null")
    filled = F.when(F.col("n") > 0, F.struct("at", "first", "first_bytes"))
    ended = F.when(F.col("n") > 0, F.struct("at", "last"))
    found = titled.groupBy("file", "head").agg(
        F.sum("bases").alias("length"),
        F.sum("n").alias("n"),
        F.max("most").alias("most"),
        F.min(filled).alias("first"),
        F.max(ended).alias("final"),
    )
    width = F.coalesce("first.first", F.lit(0))
    even = (F.col("n") == 0) | (
        (F.col("most") <= width) & (F.col("length") - F.col("final.last") == (F.col("n") - 1) * width)
    )
    uneven = F.raise_error(F.concat(F.lit("lines of unequal size in sequence "), F.col("head.title")))
    return found.select(
        F.when(even, F.col("head.title")).otherwise(uneven.cast("string")).alias("chrom"),
        F.col("head.base").alias("base"),
        "length",
        "file",
        F.col("head.start").alias("start"),
        width.alias("line_bases"),
        F.coalesce("first.first_bytes", F.lit(0)).alias("line_bytes"),
    )


def read_segments(index: DataFrame, segments: DataFrame, gap: int = 1 << 16) -> DataFrame:
    """``chrom,start,end,seq,length,bytes_read`` of distinct 0-based half-open segments, read
    from the files of a ``fasta_index``; unknown chromosomes give no row.

    Segments become byte ranges of the pieces they overlap, sorted by file and place over
    the tasks; those less than ``gap`` bytes apart are read together. ``length`` is the
    chromosome's, ``bytes_read`` the bytes read on behalf of a segment: the first of a
    common read bears all of them.
    """
    lengths = index.groupBy("chrom").agg(F.max(F.col("base") + F.col("length")).alias("length"))
    low = F.least(F.greatest("start", F.lit(0)), "length")
    known = (
        segments.select("chrom", "start", "end")
        .distinct()
        .join(lengths, "chrom")
        .withColumn("low", low)
        .withColumn("high", F.greatest(F.least("end", "length"), F.col("low")) - 1)
    )
    held = index.filter("length > 0").select(
        "chrom", "file", "base", (F.col("base") + F.col("length") - 1).alias("final"),
        F.col("start").alias("first"), "line_bases", "line_bytes",
    )
    met = overlap_join(known, held, ("low", "high"), ("base", "final"))

    def byte(base):
        return F.col("first") + F.floor(base / F.col("line_bases")) * F.col("line_bytes") + base % F.col("line_bases")

    wanted = met.select(
        "chrom", "start", "end", "file", "base",
        byte(F.greatest("low", "base") - F.col("base")).alias("from"),
        (byte(F.least("high", "final") - F.col("base")) + 1).alias("to"),
    )

    def run(batches):
        name, source, base, data = None, None, 0, b""
        for batch in batches:
            rows = batch.to_pylist()
            texts, sizes = [], []
            for k, row in enumerate(rows):
                if row["file"] != name:
                    if source:
                        source.close()
                    name, source, data = row["file"], open_file(row["file"]), b""
                size = 0
                if row["from"] < base or row["to"] > base + len(data):
                    stop = row["to"]
                    for other in rows[k + 1 :]:
                        if other["file"] != name or other["from"] > stop + gap or stop - row["from"] > MOST_READ:
                            break
                        stop = max(stop, other["to"])
                    base, size = row["from"], stop - row["from"]
                    data = source.read_at(size, base)
                part = data[row["from"] - base : row["to"] - base]
                texts.append(part.replace(b"\r", b"").replace(b"\n", b"").decode("ascii"))
                sizes.append(size)
            columns = [batch.column(c) for c in ("chrom", "start", "end", "base")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
                names=["chrom", "start", "end", "base", "seq", "bytes_read"],
            )
        if source:
            source.close()

    dealt = wanted.repartitionByRange("file", "from").sortWithinPartitions("file", "from")
    parts = dealt.mapInArrow(run, "chrom string, start long, end long, base long, seq string, bytes_read long")
    ordered = F.array_sort(F.collect_list(F.struct("base", "seq")))
    texts = parts.groupBy("chrom", "start", "end").agg(
        F.array_join(F.transform(ordered, lambda p: p["seq"]), "").alias("seq"),
        F.sum("bytes_read").alias("bytes_read"),
    )
    return known.join(texts, ["chrom", "start", "end"], "left").select(
        "chrom", "start", "end", F.coalesce("seq", F.lit("")).alias("seq"), "length",
        F.coalesce("bytes_read", F.lit(0)).alias("bytes_read"),
    )
