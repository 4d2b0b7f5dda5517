"""Numbered text lines."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilane.sources.blocks import block_lines, is_block_gzip
from epilane.sources.ranges import RANGE, list_files

# What a line is trimmed of, and the line ends that a pattern's end lies before.
TRIMMED = ("\r", "\t", " ", "\x85", "\u2028", "\u2029")

# Beside block-gzipped files, lines of other files are numbered from here.
PLAIN_FROM = 1 << 62


def numbered_lines(spark: SparkSession, path, range_bytes: int = RANGE) -> DataFrame:
    """``line_no,line,file`` of a text file, gzip by suffix.

    ``line_no`` grows along each file. It has gaps between splits, and is set by the
    scan itself, before anything is shuffled. Block-gzipped files are read in ranges of
    ``range_bytes`` by a task each; other gzip files are one split.
    """
    files = [] if not _may_be_gzip(path) else list_files(spark, path)
    blocked = [f for f in files if f[0].endswith((".gz", ".bgz", ".bgzf")) and is_block_gzip(f[0])]
    plain = [uri for uri, _ in files if uri not in dict(blocked)] if blocked else path
    parts = []
    if blocked:
        parts.append(block_lines(spark, blocked, range_bytes))
    if plain:
        parts.append(
            spark.read.text(plain).select(
                (F.monotonically_increasing_id() + (PLAIN_FROM if blocked else 0)).alias("line_no"),
                "value",
                F.col("_metadata.file_path").alias("file"),
            )
        )
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Few lines end in blanks; the others are not searched.
    ends = reduce(or_, [F.endswith("value", F.lit(c)) for c in TRIMMED])
    trimmed = F.rtrim(F.regexp_replace("value", r"[\r\t ]+$", ""))
    return lines.select("line_no", F.when(ends, trimmed).otherwise(F.col("value")).alias("line"), "file")


def _may_be_gzip(path) -> bool:
    """Whether a path names gzip files, or a folder or pattern that may hold some."""
    paths = [path] if isinstance(path, str) else [str(p) for p in path]
    return any(re.search(r"\.b?gzf?$|[*?{\[]", p) or not re.search(r"\.\w+$", p) for p in paths)


def line_tile(line_no: str = "line_no") -> Column:
    """Tiles of at most 2^16 consecutive lines of one split."""
    return F.shiftright(F.col(line_no), 16)


def required_fields(line: Column, count: int, what: str, exact: bool = False) -> Column:
    """Tab fields of a line; too few (or, if ``exact``, another number) fail."""
    fields = F.split(line, "\t")
    good = F.size(fields) == count if exact else F.size(fields) >= count
    problem = F.concat(F.lit(f"wrong number of fields in {what}: "), line)
    return F.when(good, fields).otherwise(F.raise_error(problem).cast("array<string>"))
