"""Chromosome orders as sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions of the lettered chromosomes in mouse order.
MOUSE_LETTERS = {"chrM": 0, "chrX": 20, "chrY": 21}


def chrom_key_mouse(chrom: Column) -> Column:
    """Mouse order: M, 1..19, X, Y."""
    key = F
    for name, place in MOUSE_LETTERS.items():
        key = key.when(chrom == name, F.lit(place))
    return key.otherwise(F.substr(chrom, F.lit(4)).cast("int"))


def chrom_key_natural(chrom: Column) -> Column:
    """Natural order: chr+number, number, chr+text, text."""
    prefixed = F.startswith(chrom, F.lit("chr"))
    rest = F.when(prefixed, F.substr(chrom, F.lit(4))).otherwise(chrom)
    number = rest.try_cast("bigint")
    return F.struct(
        number.isNull().alias("is_text"),
        (~prefixed).alias("bare"),
        F.coalesce(number, F.lit(0)).alias("number"),
        F.when(number.isNull(), rest).otherwise(F.lit("")).alias("text"),
    )


def chrom_key_first_seen(df: DataFrame, *order: str) -> DataFrame:
    """``chrom, first_seen``: the smallest (file, line) struct per chromosome."""
    return df.groupBy("chrom").agg(F.min(F.struct(*order)).alias("first_seen"))


def order_by_chrom(df: DataFrame, chroms: DataFrame, pos: str = "pos") -> DataFrame:
    """Sort by the header order of chromosomes, then by position."""
    ranked = df.join(chroms.select("chrom", "ord"), "chrom", "left")
    return ranked.orderBy("ord", pos).drop("ord")
