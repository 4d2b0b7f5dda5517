"""SAM text: records and header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilane.sources.lines import numbered_lines, required_fields


def parse_records(lines: DataFrame, fields) -> DataFrame:
    """Typed record columns from the tab fields of a line."""

    def at(i):
        return F.get(F.col("f"), F.lit(i))

    return lines.withColumn("f", fields).select(
        "line_no",
        at(0).alias("qname"),
        at(1).cast("int").alias("flag"),
        at(2).alias("rname"),
        at(3).cast("bigint").alias("pos"),
        at(4).cast("int").alias("mapq"),
        at(5).alias("cigar"),
        at(6).alias("rnext"),
        at(7).cast("bigint").alias("pnext"),
        at(8).cast("int").alias("tlen"),
        at(9).alias("seq"),
        at(10).alias("qual"),
        F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))).alias("tags"),
    )


def read_sam(spark: SparkSession, path, min_fields: int = 11, mode: str = "fail") -> DataFrame:
    """Alignment records. A record below ``min_fields`` fields fails, or is left out
    with ``mode='permissive'`` (see ``rejected_sam``)."""
    lines = numbered_lines(spark, path).filter((F.col("line") != "") & ~F.startswith("line", F.lit("@")))
    if mode == "permissive":
        good = lines.filter(F.size(F.split("line", "\t")) >= min_fields)
        return parse_records(good, F.split("line", "\t"))
    if mode != "fail":
        raise ValueError("mode must be 'fail' or 'permissive'")
    return parse_records(lines, required_fields(F.col("line"), min_fields, "SAM record"))


def rejected_sam(spark: SparkSession, path, min_fields: int = 11) -> DataFrame:
    """``line_no,line`` of the records too short to parse."""
    return (
        numbered_lines(spark, path)
        .filter((F.col("line") != "") & ~F.startswith("line", F.lit("@")))
        .filter(F.size(F.split("line", "\t")) < min_fields)
        .select("line_no", "line")
    )


def read_sam_header(spark: SparkSession, path) -> DataFrame:
    """``ord,chrom,length`` of the reference sequences; ``ord`` follows the header."""
    return (
        numbered_lines(spark, path)
        .filter(F.startswith("line", F.lit("@SQ\t")))
        .select(
            F.col("line_no").alias("ord"),
            F.regexp_extract("line", r"\tSN:([^\t]+)", 1).alias("chrom"),
            F.regexp_extract("line", r"\tLN:(\d+)", 1).try_cast("bigint").alias("length"),
        )
    )


def read_header_lines(spark: SparkSession, path) -> DataFrame:
    """``line_no,line`` of all header lines."""
    return (
        numbered_lines(spark, path)
        .filter(F.startswith("line", F.lit("@")))
        .select("line_no", "line")
    )


def is_coordinate_sorted(spark: SparkSession, path) -> DataFrame:
    """One row: whether the header declares coordinate order."""
    return read_header_lines(spark, path).agg(
        F.coalesce(
            F.bool_or(
                F.startswith("line", F.lit("@HD\t"))
                & F.array_contains(F.split("line", "\t"), "SO:coordinate")
            ),
            F.lit(False),
        ).alias("coordinate_sorted")
    )
