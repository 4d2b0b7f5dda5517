"""Linked methylation: the calls of each read across a region, as one pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.operators.intervals import interval_join
from epilane.operators.ordered import running
from epilane.session import cut_lineage


def sparse_pattern(entries: Column, size: Column, blank: str = "-") -> Column:
    """Text of ``size`` characters from sorted ``array<struct<idx,mark>>`` entries."""
    spaced = F.transform(
        entries,
        lambda e, k: F.concat(
            F.repeat(
                F.lit(blank),
                (e["idx"] - F.when(k == 0, -1).otherwise(F.get(entries, k - 1)["idx"]) - 1).cast("int"),
            ),
            e["mark"],
        ),
    )
    last = F.get(entries, F.size(entries) - 1)["idx"]
    return F.concat(
        F.array_join(spaced, ""),
        F.repeat(F.lit(blank), (size - 1 - last).cast("int")),
    )


def _site_order(hits: DataFrame) -> DataFrame:
    sites = hits.select("name", "pos").distinct()
    return running(sites, ["name"], ["pos"], {"seen": ("sum", F.lit(1))}).select(
        "name", "pos", (F.col("seen") - 1).alias("idx")
    )


def linked_sites(calls: DataFrame, bed: DataFrame) -> DataFrame:
    """``name,pos,idx``: the called sites of each region and their order."""
    sites = calls.select("chrom", F.col("loc").alias("pos")).distinct()
    return _site_order(interval_join(sites, bed))


def linked_methylation(calls: DataFrame, bed: DataFrame, conflicts: str = "fail") -> DataFrame:
    """``name,chrom,start,end,sites,qname,pattern``: one row per region and read.

    The pattern has ``0``, ``1`` or ``-`` per site; a region without sites keeps one
    row with pattern ``<none>``. Insertion-made calls are included. Several calls of
    one read at a site fail, or are blanked with ``conflicts='blank'``.
    """
    if conflicts not in ("fail", "blank"):
        raise ValueError("conflicts must be 'fail' or 'blank'")
    problem = F.lit("-")
    if conflicts == "fail":
        problem = F.raise_error(
            F.concat(F.lit("calls of both states at one site, read "), F.col("qname"))
        ).cast("string")
    hits = cut_lineage(
        interval_join(calls.select("chrom", F.col("loc").alias("pos"), "qname", "call"), bed)
        .groupBy("name", "qname", "pos")
        .agg(
            F.count_if(F.col("call") == "z").alias("unmeth"),
            F.count_if(F.col("call") == "Z").alias("meth"),
        )
    )
    mark = (
        F.when(F.col("unmeth") == 1, F.lit("0"))
        .when(F.col("meth") == 1, F.lit("1"))
        .otherwise(problem)
    )
    sites = _site_order(hits)
    sizes = sites.groupBy("name").agg(F.count(F.lit(1)).alias("sites"))
    # A read holds each site of a region once, so the list is never longer than the pattern.
    patterns = (
        hits.join(sites, ["name", "pos"])
        .groupBy("name", "qname")
        .agg(F.array_sort(F.collect_list(F.struct("idx", mark.alias("mark")))).alias("entries"))
        .join(sizes, "name")
        .select(
            "name",
            "qname",
            "sites",
            sparse_pattern(F.col("entries"), F.col("sites")).alias("pattern"),
        )
    )
    return bed.select("name", "chrom", "start", "end").join(patterns, "name", "left").select(
        "name",
        "chrom",
        "start",
        "end",
        F.coalesce("sites", F.lit(0)).cast("bigint").alias("sites"),
        "qname",
        F.coalesce("pattern", F.lit("<none>")).alias("pattern"),
    )
