"""Registered text-to-text flows: tables written in their formats and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from epilane.operators import calls, difftest, duplicates, expression, linked, regions
from epilane.plans import catalog, oracles, tables
from epilane.session import Scratch, cut_lineage
from epilane.sources import alignments, parts, sinks, store
from epilane.sources import tables as sources

TAB = "\t"


def bed_roundtrip(spark, folder):
    """Regions written as gzip BED and read back by name."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/regions.bed.gz"
        sinks.write_bed(tables.bed(spark, folder).withColumnRenamed("name", "qname"), path)
        return scratch.result(sources.read_bed(spark, path))


def regions_roundtrip(spark, folder):
    """Region table with N and X columns, written and read back as long rows."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/regions"
        sinks.write_regions(catalog.regions_nx(spark, folder), path)
        return scratch.result(sources.read_regions(spark, path, catalog.SAMPLES))


def fractions_roundtrip(spark, folder):
    """Region table with fractions, written with six decimals and read back."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/regions"
        wide = regions.regions_wide(catalog._regions(spark, folder), catalog.SAMPLES, fraction=True)
        sinks.write_regions(wide, path)
        return scratch.result(
            sources.read_regions(spark, path, catalog.SAMPLES).withColumn("x", F.round("x", 6))
        )


def dup_names_roundtrip(spark, folder):
    """Duplicate list written, and its read names read back."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/dups"
        sinks.write_dups(duplicates.find_dups(tables.alignments(spark, folder)), path)
        return scratch.result(sources.read_names(spark, path))


def header_roundtrip(spark, folder):
    """Alignments under a header, whose chromosomes are written and read as an order."""
    genome = tables.genome(spark, folder)
    lengths = genome.groupBy("chrom").agg(F.max(F.col("offset") + F.length("seq")).alias("length"))
    place = F.lit(6) - F.substr(F.col("chrom"), F.lit(4)).cast("bigint")
    named = lengths.select(
        place.alias("line_no"),
        F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:"), F.col("length").cast("string")).alias("line"),
    )
    first = spark.range(1).select(
        F.lit(0).cast("bigint").alias("line_no"), F.lit("@HD\tVN:1.6\tSO:coordinate").alias("line")
    )
    with Scratch(spark) as scratch:
        path, order = f"{scratch.path}/sam", f"{scratch.path}/order"
        sinks.write_sam(tables.alignments(spark, folder), first.unionByName(named), path)
        header = alignments.read_sam_header(spark, path)
        sinks.write_chrom_order(header, order)
        placed = sources.read_chrom_order(spark, order)
        # One row per chromosome.
        ranks = placed.select(
            "chrom", F.row_number().over(Window.orderBy("ord")).cast("bigint").alias("place")
        )
        sorted_ = alignments.is_coordinate_sorted(spark, path)
        records = alignments.read_sam(spark, path).groupBy("rname").agg(F.count("*").alias("records"))
        return scratch.result(
            header.select("chrom", "length")
            .join(ranks, "chrom")
            .join(records, F.col("rname") == F.col("chrom"))
            .withColumn("header", F.lit(1))
            .join(sorted_.withColumn("header", F.lit(1)), "header")
            .select("chrom", "length", "place", "records", "coordinate_sorted")
        )


def run_summary(spark, folder):
    """Record counts and call figures of a run, one row per item."""
    sam = tables.alignments(spark, folder)
    rows = sinks.run_summary(sam, calls.cpg_summary(sam))
    return rows.withColumn("value", F.round("value", 6))


def gene_diff_roundtrip(spark, folder):
    """Comparison table of fourteen columns, written and read back."""
    diff = tables.gene_diff(spark, folder)
    fold = (
        F.when(F.col("fold") == float("inf"), "inf")
        .when(F.col("fold") == float("-inf"), "-inf")
        .otherwise(F.col("fold").cast("string"))
    )
    filler = [F.lit("-").alias(f"c{i}") for i in (1, 2, 3, 7, 8, 10, 11, 12)]
    table = diff.select(
        F.col("gene").alias("test_id"), *filler[:3], "sample_1", "sample_2", "status", *filler[3:5],
        fold.alias("log2(fold_change)"), *filler[5:], "significant",
    )
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/gene_exp.diff"
        table.write.options(sep=TAB, header=True, quote="").csv(path)
        return scratch.result(sources.read_gene_diff(spark, path))


def feature_counts_roundtrip(spark, folder):
    """Gene counts under a header of file names, read back and reshaped."""
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    part = spark.read.parquet(f"{folder}/part.parquet")
    quantity = F.col("l_quantity").cast("bigint")
    table = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("Geneid"))
        .agg(
            F.lit("chr1;chr2").alias("Chr"),
            F.lit("1;5").alias("Start"),
            F.lit("2;9").alias("End"),
            F.lit("+;-").alias("Strand"),
            F.max("p_size").alias("Length"),
            *(
                F.sum(F.when(F.col("l_returnflag") == f, quantity)).alias(f"run/{f}/out.bam")
                for f in "ANR"
            ),
        )
    )
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/counts.txt"
        table.write.options(sep=TAB, header=True, quote="").csv(path)
        return scratch.result(expression.gene_matrix(sources.read_feature_counts(spark, path)))


def linked_report(spark, folder):
    """Lines of the report on linked methylation."""
    found, windows = catalog._calls(spark, folder), tables.windows(spark, folder)
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/linked"
        report = linked.linked_methylation(found, windows, conflicts="blank")
        sinks.write_linked(report, linked.linked_sites(found, windows), path)
        return scratch.result(spark.read.text(path).filter("value <> ''"))


def diff_with_samples(spark, folder):
    """Two-group comparison with the values of its samples and a column of the region."""
    groups = {g: catalog.GROUPS[g] for g in "AN"}
    rows = catalog._regions(spark, folder).withColumn(
        "gene", F.concat(F.lit("g"), F.col("start").cast("string"))
    )
    tests = difftest.diff_meth(rows, groups, min_diff=0.05, max_p=0.2, keep_na_p=True)
    wide = difftest.with_samples(tests, rows, groups["A"] + groups["N"], keep=["gene"])
    return wide.select(
        "chrom", "start", "end", "cpg", "gene",
        *(F.round(c, 6).alias(c) for c in ("mu1", "mu2", "diff", "pval", *groups["A"], *groups["N"])),
    )


def _matrix_lines(spark, wide):
    """The lines of a matrix as written, without headers."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/matrix"
        sinks.write_matrix(wide, path)
        head = TAB.join(wide.columns)
        return scratch.result(spark.read.text(path).filter(F.col("value") != head))


def gene_matrix_lines(spark, folder):
    """Gene counts as lines of text."""
    return _matrix_lines(spark, catalog.gene_matrix(spark, folder))


def base_quality_lines(spark, folder):
    """Base qualities as lines of text, without the fractional figures."""
    return _matrix_lines(spark, catalog.base_quality(spark, folder).select("base", "n"))


def cpg_summary_lines(spark, folder):
    """Site summary of the regions as lines of text."""
    return _matrix_lines(spark, catalog.region_cpg_summary(spark, folder))


def dmrs_roundtrip(spark, folder):
    """Region tests, written as a table and read back."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/dmrs"
        wide = catalog.wald_wide(spark, folder)
        sinks.write_dmrs(wide, path)
        return scratch.result(sources.read_dmrs(spark, path))


def counts_ordered(spark, folder):
    """Counts written in natural order as block-gzipped parts, and read back by ranges with
    the place of each line."""
    rows = tables.counts(spark, folder).select(
        F.substr(F.col("chrom"), F.lit(4)).cast("int").alias("ord"),
        "pos",
        "sample",
        F.concat_ws(TAB, "chrom", F.col("pos").cast("string"), "sample", F.col("meth").cast("string"), F.col("unmeth").cast("string")).alias("value"),
    )
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/counts.gz"
        parts.write_ordered(rows, ["ord", "pos", "sample"], path, header="chrom\tpos\tsample\tmeth\tunmeth")
        parts.check_order(spark, path)
        return scratch.result(parts.read_ordered(spark, path))


def regions_nx_stored(spark, folder):
    """Region table from counts stored by place."""
    name = f"epilane_counts_{uuid.uuid4().hex}"
    with Scratch(spark) as scratch:
        try:
            counts = store.store_counts(tables.counts(spark, folder), name, f"{scratch.path}/counts")
            found = regions.combine_regions(counts, max_len=None, min_cpg=2)
            return scratch.result(regions.regions_wide(found, catalog.SAMPLES))
        finally:
            spark.sql(f"drop table if exists {name}")


def hit_pairs(spark, folder):
    """Pairs of alignments by hit index or coordinates, with clips and splices in the keys."""
    # No score is asked for here.
    return duplicates.pair_reads(
        cut_lineage(duplicates.alignment_keys(tables.hits(spark, folder)).drop("score"))
    )


def dups_many_keys(spark, folder):
    """Ranked duplicates of reads that have several keys each."""
    return duplicates.find_dups(tables.hits(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        bed_roundtrip,
        regions_roundtrip,
        fractions_roundtrip,
        dup_names_roundtrip,
        header_roundtrip,
        run_summary,
        gene_diff_roundtrip,
        feature_counts_roundtrip,
        linked_report,
        diff_with_samples,
        gene_matrix_lines,
        base_quality_lines,
        cpg_summary_lines,
        dmrs_roundtrip,
        counts_ordered,
        regions_nx_stored,
        hit_pairs,
        dups_many_keys,
    )
}

_REGION_CTES = ("counts", oracles._SITES, oracles._CLUSTERED, oracles._REGIONS)

ORACLES = {
    "bed_roundtrip": oracles._with("bed", body='select chrom, start, end_ as "end", name from bed'),
    "regions_roundtrip": oracles._with(
        *_REGION_CTES, body='select chrom, start, end_ as "end", cpg, sample, n, x from regions'
    ),
    "fractions_roundtrip": oracles._with(
        *_REGION_CTES,
        body="""select chrom, start, end_ as "end", cpg, sample, cast(1 as double) as n,
                  round(cast(x as double) / n, 6) as x from regions""",
    ),
    "dup_names_roundtrip": f"select qname from ({oracles.ORACLES['dups_ranked']}) d",
    "header_roundtrip": oracles._with(
        "aln genome",
        "lengths as (select chrom, max(offset_ + length(seq)) as length from genome group by 1)",
        body="""select l.chrom, l.length, 6 - cast(substr(l.chrom, 4) as bigint) as place,
                  count(*) as records, true as coordinate_sorted
                from lengths l join aln a on a.rname = l.chrom group by 1, 2, 3""",
    ),
    "run_summary": oracles._with(
        "aln",
        "counted as (select count(*) as records, count(case when (flag & 256) <> 0 then 1 end) as not_primary from aln)",
        f"summed as ({oracles.ORACLES['cpg_summary']})",
        body=" union all ".join(
            f"select '{item}' as item, round(cast({item} as double), 6) as value from {table}"
            for table, items in (
                ("counted", ("records", "not_primary")),
                ("summed", ("reads", "mapped", "calls", "methylated", "unmethylated", "pct")),
            )
            for item in items
        ),
    ),
    "gene_diff_roundtrip": oracles._with(
        "gene_diff", body="select gene, sample_1, sample_2, status, fold, significant from gene_diff"
    ),
    "feature_counts_roundtrip": """
select p_brand as "Symbol", cast(max(p_size) as bigint) as "Length",
  """
    + ", ".join(
        f"cast(sum(case when l_returnflag = '{f}' then cast(l_quantity as bigint) end) as bigint) as \"{f}\""
        for f in "ANR"
    )
    + " from lineitem join part on l_partkey = p_partkey group by 1",
    "linked_report": oracles._with(
        "aln windows",
        oracles._CALLS,
        oracles._LINKED,
        "listed as (select name, string_agg(cast(pos as varchar(20)), ', ' order by pos) as listing from region_sites group by 1)",
        body="""select concat('Region: ', name, ', ', chrom, ':', cast(start as varchar(20)), '-', cast(end_ as varchar(20))) as value from windows
                union all select concat('Sites: ', coalesce(listing, '<none>')) from windows w left join listed l on l.name = w.name
                union all select concat(pattern, chr(9), qname) from patterns""",
    ),
}


def _joined_line(columns: str) -> str:
    """SQL for a line of text of some columns; nulls are written as NA."""
    cells = [f"coalesce(cast(\"{c}\" as varchar(200)), 'NA')" for c in columns.split()]
    return "select concat(" + ", chr(9), ".join(cells) + ") as value"


ORACLES |= {
    "diff_with_samples": oracles._with(
        *_REGION_CTES,
        oracles._GROUPED,
        oracles._SIMPSON,
        """ws as (select *, k1 >= 2 and k2 >= 2 as enough, lo1 = hi1 and lo2 = hi2 as flat, v1 / k1 + v2 / k2 as se,
             (v1 / k1) * (v1 / k1) / (k1 - 1) + (v2 / k2) * (v2 / k2) / (k2 - 1) as sd from pairs where g1 = 'A' and g2 = 'N')""",
        """ts as (select *, case when enough and not flat then (mu1 - mu2) / sqrt(se) end as t,
             case when enough and not flat then se * se / sd end as df from ws)""",
        """tails as (select chrom, start, 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) *
               sum(w * 4 * power(b * i / 400, 3) * power(sin(power(b * i / 400, 4)), df - 1)) * b / 1200 as tail
             from (select *, power(atan2(sqrt(df), abs(t)), 0.25) as b from ts where t is not null) x cross join steps
             group by chrom, start, df, b)""",
        """tested as (select ts.*, case when not enough or diff is null then null when diff = 0 then 1 when flat then 0 else tail end as pval
             from ts left join tails a on a.chrom = ts.chrom and a.start = ts.start)""",
        "cells as (select chrom, start, "
        + ", ".join(
            f"max(case when sample = '{s}' then x / n end) as {s}" for s in ("AF", "AO", "NF", "NO")
        )
        + " from regions group by 1, 2)",
        body="""select t.chrom, t.start, end_ as "end", cpg, concat('g', cast(t.start as varchar(20))) as gene,
                  round(mu1, 6) as mu1, round(mu2, 6) as mu2, round(diff, 6) as diff, round(pval, 6) as pval,
                  round(AF, 6) as "AF", round(AO, 6) as "AO", round(NF, 6) as "NF", round(NO, 6) as "NO"
                from tested t join cells c on c.chrom = t.chrom and c.start = t.start
                where abs(diff) >= 0.05 and (pval is null or pval <= 0.2)""",
    ),
    "gene_matrix_lines": _joined_line("Symbol Length A N R")
    + f" from ({oracles.ORACLES['gene_matrix']}) m",
    "base_quality_lines": _joined_line("base n") + f" from ({oracles.ORACLES['base_quality']}) m",
    "cpg_summary_lines": _joined_line("name chr_pos site meth unmeth")
    + f" from ({oracles.ORACLES['region_cpg_summary']}) m",
}

ORACLES["hit_pairs"] = oracles._with(
    "hits",
    """keyed as (select *, line_no - case when (flag & 128) <> 0 then 1 else 0 end as slot, (flag & 128) <> 0 as last,
         concat('(''', rname, ''', ', cast(pos + case cigar when '5S27M' then -5 else 0 end
             + case when (flag & 16) = 0 then 0 when cigar = '10M100N22M' then 132 else 32 end as varchar(20)), ', ',
           case when cigar <> '10M100N22M' then '()' when (flag & 16) = 0 then '(''10-100'',)' else '(''22-100'',)' end,
           ', ''', case when (flag & 16) <> 0 then '-' else '+' end, ''')') as key
       from hits)""",
    body="""select a.qname, a.line_no, a.key as aln0, b.key as aln1
            from keyed a join keyed b on b.qname = a.qname and b.slot = a.slot and b.last where not a.last""",
)

ORACLES["regions_nx_stored"] = oracles.ORACLES["regions_nx"]
ORACLES["dmrs_roundtrip"] = oracles.ORACLES["wald_wide"]
ORACLES["counts_ordered"] = oracles._with(
    "counts",
    body="""select row_number() over (order by cast(substr(chrom, 4) as int), pos, sample) - 1 as place,
              concat_ws(chr(9), chrom, cast(pos as varchar(20)), sample, cast(meth as varchar(20)), cast(unmeth as varchar(20))) as line
            from counts""",
)
