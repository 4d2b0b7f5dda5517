"""Clustering CpG sites into regions and summing sample counts over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epilane.functions.checks import check_range
from epilane.functions.sequence import cpg_count, meth_frac
from epilane.operators.intervals import CHUNK, interval_join, slice_genome
from epilane.operators.ordered import TILE, running
from epilane.session import cut_lineage

REGION = ["chrom", "region_start"]


def union_samples(samples: list[DataFrame]) -> DataFrame:
    """One long counts table; a position repeated within a sample fails."""
    merged = samples[0]
    for df in samples[1:]:
        merged = merged.unionByName(df)
    once = F.when(
        F.count(F.lit(1)) > 1,
        F.raise_error(F.lit("position repeated within a sample")).cast("bigint"),
    )
    return merged.groupBy("sample", "chrom", "pos").agg(
        F.coalesce(once, F.max("meth")).alias("meth"), F.max("unmeth").alias("unmeth")
    )


def site_keys(df: DataFrame) -> list[str]:
    """Columns that name a site; those of stored counts begin with what they are bucketed by."""
    return ["chrom", "tile", "pos"] if "tile" in df.columns else ["chrom", "pos"]


def qualify_sites(counts: DataFrame, min_reads: int = 3, min_samples: int = 1) -> DataFrame:
    """Sites where at least ``min_samples`` samples have ``min_reads`` counts."""
    covered = F.count_if(F.col("meth") + F.col("unmeth") >= min_reads)
    return (
        counts.groupBy(*site_keys(counts))
        .agg(covered.alias("n_samples"))
        .filter(F.col("n_samples") >= max(min_samples, 1))
    )


def cluster_sites(sites: DataFrame, max_dist: int = 100, tile: int = TILE) -> DataFrame:
    """``chrom,pos,region_start``: a gap above ``max_dist`` starts a new region.

    Gaps are found inside tiles of the chromosome; one row per tile carries the last
    site and the open region over to the next tile, so no task sorts a chromosome. Sites of
    stored counts keep their ``tile``, whatever ``tile`` is given.
    """
    stored = site_keys(sites)[1:-1]
    inside = W.partitionBy("chrom", "_tile").orderBy("pos")
    along = W.partitionBy("chrom").orderBy("_tile")
    own = F.col("tile") if stored else F.floor(F.col("pos") / tile)
    tiled = sites.select("chrom", "pos", own.alias("_tile"))
    opened = tiled.withColumn(
        "_open",
        F.when(F.col("pos") - F.lag("pos").over(inside) > max_dist, F.col("pos")),
    )
    local = opened.withColumn(
        "_open", F.max("_open").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    tiles = opened.groupBy("chrom", "_tile").agg(
        F.min("pos").alias("_first"), F.max("pos").alias("_last"), F.max("_open").alias("_open_last")
    )
    before = F.lag("_last").over(along)
    fresh = before.isNull() | (F.col("_first") - before > max_dist)
    entered = tiles.withColumn("_enter", F.when(fresh, F.col("_first"))).withColumn(
        "_carried",
        F.max(F.greatest("_enter", "_open_last")).over(
            along.rowsBetween(W.unboundedPreceding, -1)
        ),
    )
    return local.join(entered.select("chrom", "_tile", "_enter", "_carried"), ["chrom", "_tile"]).select(
        "chrom",
        *[F.col("_tile").alias(c) for c in stored],
        "pos",
        F.greatest("_open", "_enter", "_carried").alias("region_start"),
    )


def region_extents(site_regions: DataFrame) -> DataFrame:
    """``chrom,region_start,end,cpg`` per region."""
    return site_regions.groupBy(*REGION).agg(
        F.max("pos").alias("end"), F.count(F.lit(1)).alias("cpg")
    )


def _cut_targets(batches):
    """Position each cut has to pass: the start plus repeated additions of the piece
    length, in double arithmetic as the rule adds them one by one."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            at, length = float(row.region_start), (row.end - row.region_start) / row.pieces
            for first in range(1, row.pieces, 1 << 16):
                size = min(1 << 16, row.pieces - first)
                steps = np.full(size + 1, length)
                steps[0] = at
                targets = np.cumsum(steps)[1:]
                at = float(targets[-1])
                yield pd.DataFrame(
                    {
                        "chrom": row.chrom,
                        "region_start": row.region_start,
                        "at": targets,
                        "cut_no": np.arange(first, first + size, dtype="int64"),
                        "cpg": row.cpg,
                        "pieces": row.pieces,
                    }
                )


def _split_float(sites: DataFrame, extents: DataFrame, max_len: int, min_cpg: int, tile: int):
    """Balanced split where every piece keeps ``min_cpg`` sites.

    Cut i is the first site past its target that leaves ``min_cpg`` sites since cut
    i-1, that is ``cut(i) = max(passed(i), cut(i-1) + c)``. Subtracting ``i*c`` turns the
    recursion into a running maximum; filling up from the back is an upper bound of
    ``n - (k-i)*c``. So no region has to be walked site by site.
    """
    span = F.col("end") - F.col("region_start")
    plan = extents.withColumn(
        "pieces",
        F.least(F.ceil(span / F.lit(float(max_len))), F.floor(F.col("cpg") / min_cpg)),
    )
    targets = plan.filter("pieces > 1").mapInPandas(
        _cut_targets,
        "chrom string, region_start bigint, at double, cut_no bigint, cpg bigint, pieces bigint",
    )
    marks = sites.select(*REGION, F.col("pos").cast("double").alias("at")).withColumns(
        {name: F.lit(None).cast("bigint") for name in ("cut_no", "cpg", "pieces")}
    )
    is_site = F.col("cut_no").isNull()
    counted = cut_lineage(
        running(
            marks.unionByName(targets).withColumn("kind", F.when(is_site, 0).otherwise(1)),
            REGION,
            ["at", "kind", "cut_no"],
            {"seen": ("sum", F.when(is_site, 1).otherwise(0))},
            F.floor(F.col("at") / tile),
        )
    )
    cuts = running(
        counted.filter(~is_site),
        REGION,
        ["cut_no"],
        {"lead": ("max", F.col("seen") - F.col("cut_no") * min_cpg)},
        F.floor(F.col("at") / tile),
    ).select(
        *REGION,
        F.least(
            F.col("cut_no") * min_cpg + F.greatest(F.col("lead"), F.lit(0)),
            F.col("cpg") - (F.col("pieces") - F.col("cut_no")) * min_cpg,
        ).alias("idx"),
        F.lit(True).alias("is_cut"),
    )
    indexed = counted.filter(is_site).select(
        *REGION, F.col("at").cast("bigint").alias("pos"), (F.col("seen") - 1).alias("idx")
    )
    starts = indexed.join(cuts, [*REGION, "idx"], "left")
    opens = F.col("is_cut") | (F.col("idx") == 0)
    return running(
        starts,
        REGION,
        ["pos"],
        {"piece_start": ("max", F.when(opens, F.col("pos")))},
        F.floor(F.col("pos") / tile),
    ).select("chrom", "pos", F.col("piece_start").alias("region_start"))


def _split_integer(sites: DataFrame, extents: DataFrame, max_len: int) -> DataFrame:
    """Equal integer lengths, pieces of one site or more; pieces that are still too
    long are split again."""
    done = None
    while True:
        span = F.col("end") - F.col("region_start")
        pieces = F.ceil(span / F.lit(float(max_len)))
        step = F.greatest(F.floor(span / pieces), F.lit(1))
        offset = F.greatest(F.col("pos") - F.col("region_start"), F.lit(1)) - 1
        placed = sites.join(extents, REGION).withColumn(
            "piece", F.least(pieces - 1, F.floor(offset / step))
        )
        firsts = placed.groupBy(*REGION, "piece").agg(F.min("pos").alias("piece_start"))
        moved = cut_lineage(
            placed.join(firsts, [*REGION, "piece"]).select(
                "chrom", "pos", F.col("piece_start").alias("region_start")
            )
        )
        sizes = region_extents(moved)
        extents = sizes.filter(F.col("end") - F.col("region_start") > max_len)
        short = moved.join(extents.select(*REGION), REGION, "left_anti")
        done = short if done is None else done.unionByName(short)
        if extents.isEmpty():
            return done
        sites = moved.join(extents.select(*REGION), REGION, "left_semi")


def split_regions(
    site_regions: DataFrame,
    max_len: int = 500,
    min_cpg: int = 3,
    version: str = "float",
    tile: int = TILE,
) -> DataFrame:
    """Drop regions below ``min_cpg`` sites and split those longer than ``max_len``.

    ``version='float'`` balances pieces and keeps ``min_cpg`` in each; ``'integer'``
    cuts at integer multiples and accepts single sites. Short regions pass through.
    The site table, far smaller than the counts, is written once and read per step.
    """
    check_range(min_cpg, lo=1, name="min_cpg")
    check_range(max_len, lo=1, name="max_len")
    site_regions = cut_lineage(site_regions)
    extents = region_extents(site_regions).filter(F.col("cpg") >= min_cpg)
    is_long = F.col("end") - F.col("region_start") > max_len
    marked = site_regions.join(extents.withColumn("is_long", is_long), REGION)
    columns = ["chrom", "pos", "region_start"]
    short = marked.filter(~F.col("is_long")).select(*columns)
    long_sites = marked.filter("is_long").select(*columns)
    long_extents = extents.filter(is_long)
    if long_extents.isEmpty():
        return short
    if version == "float":
        pieces = _split_float(long_sites, long_extents, max_len, min_cpg, tile)
    elif version == "integer":
        pieces = _split_integer(long_sites, long_extents, max_len)
    else:
        raise ValueError("version must be 'float' or 'integer'")
    return short.unionByName(pieces)


def combine_regions(
    counts: DataFrame,
    min_reads: int = 3,
    min_samples: int = 1,
    max_dist: int = 100,
    min_cpg: int = 3,
    max_len: int | None = 500,
    min_reg: int = 20,
    version: str = "float",
    tile: int = TILE,
) -> DataFrame:
    """``chrom,start,end,cpg,sample,n,x``: total and methylated counts per region and
    sample. Cells below ``min_reg`` counts are left out, and with them regions that
    have no other cell. All samples' counts at a qualifying site enter the sums. A
    position with several rows of one sample fails. Stored counts (``sources.store``) are
    grouped, clustered and joined without being shuffled.
    """
    check_range(min_reg, lo=1, name="min_reg")
    clustered = cluster_sites(qualify_sites(counts, min_reads, min_samples), max_dist, tile)
    if max_len is None:
        # Distinct sites only, written once: the counts are then read for the sums alone.
        placed = clustered if "tile" in counts.columns else cut_lineage(clustered)
        extents = region_extents(placed).filter(F.col("cpg") >= max(min_cpg, 1))
    else:
        placed = split_regions(clustered, max_len, min_cpg, version, tile)
        extents = region_extents(placed)
    # The join already deals rows by position, so this check needs no other shuffle.
    again = F.raise_error(
        F.concat_ws(" ", F.lit("more than one row for"), "sample", "chrom", F.col("pos").cast("string"))
    )
    keys = site_keys(counts)
    if set(keys) - set(placed.columns):
        placed = placed.withColumn("tile", F.floor(F.col("pos") / TILE))
    single = (
        counts.join(placed, keys)
        .groupBy(*keys, "sample", "region_start")
        .agg(F.count("*").alias("_rows"), F.max("meth").alias("meth"), F.max("unmeth").alias("unmeth"))
        .withColumn("meth", F.when(F.col("_rows") == 1, F.col("meth")).otherwise(again.cast("bigint")))
    )
    sums = (
        single.groupBy(*REGION, "sample")
        .agg(F.sum(F.col("meth") + F.col("unmeth")).alias("n"), F.sum("meth").alias("x"))
        .filter(F.col("n") >= min_reg)
    )
    return sums.join(extents, REGION).select(
        "chrom", F.col("region_start").alias("start"), "end", "cpg", "sample", "n", "x"
    )


def regions_wide(
    region_counts: DataFrame, samples: list[str], fraction: bool = False, keys: list[str] | None = None
) -> DataFrame:
    """One row per region: a fraction per sample, or ``<sample>-N`` and ``<sample>-X``."""
    keys = keys or ["chrom", "start", "end", "cpg"]

    def cell(name, value):
        return F.max(F.when(F.col("sample") == name, value))

    aggs = []
    for name in samples:
        if fraction:
            aggs.append(cell(name, F.col("x") / F.col("n")).alias(name))
        else:
            aggs.append(cell(name, F.col("n")).alias(f"{name}-N"))
            aggs.append(cell(name, F.col("x")).alias(f"{name}-X"))
    return region_counts.groupBy(*keys).agg(*aggs)


def combine_bed(
    counts: DataFrame, bed: DataFrame, genome: DataFrame | None = None, chunk_size: int = CHUNK
) -> DataFrame:
    """``chrom,start,end,cpg,sample,frac`` for given regions, each widened by one base.

    Counts are 1-based, regions 0-based; a region without counts keeps one row with
    NULL sample, and a region given twice has its rows twice. ``cpg`` is NULL where the
    genome lacks the chromosome.
    """
    given = bed.select(
        "chrom",
        (F.col("start") - 1).alias("start"),
        (F.col("end") + 1).alias("end"),
    )
    wide = given.distinct()
    inside = interval_join(
        counts.withColumn("pos", F.col("pos") - 1).filter(F.col("meth") + F.col("unmeth") > 0),
        wide,
    )
    sums = inside.groupBy("chrom", "start", "end", "sample").agg(
        F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth")
    )
    if genome is None:
        regions = wide.withColumn("cpg", F.lit(None).cast("int"))
    else:
        text = slice_genome(wide, genome, chunk_size).select(
            "chrom", "start", "end", cpg_count(F.col("seq")).alias("cpg")
        )
        regions = wide.join(text, ["chrom", "start", "end"], "left")
    found = given.join(regions, ["chrom", "start", "end"])
    return found.join(sums, ["chrom", "start", "end"], "left").select(
        "chrom",
        "start",
        "end",
        "cpg",
        "sample",
        meth_frac(F.col("meth"), F.col("unmeth")).alias("frac"),
    )
