"""Registered queries: every operator over the whole derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilane.functions import chrom, sam, sequence
from epilane.operators import (
    calls,
    difftest,
    duplicates,
    expression,
    intervals,
    linked,
    pileup,
    quality,
    reads,
    regions,
    segments,
    wald,
)
from epilane.plans import tables
from epilane.session import Scratch
from epilane.sources import alignments, sequences, sinks
from epilane.sources import tables as sources

SAMPLES = ["AF", "AO", "NF", "NO", "RF", "RO"]
GROUPS = {"A": ["AF", "AO"], "N": ["NF", "NO"], "R": ["RF", "RO"]}
KEYS = ["chrom", "start", "end", "cpg"]
DIGITS = 6


def _rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n), DIGITS) for n in names})


def _regions(spark, folder):
    return regions.combine_regions(tables.counts(spark, folder), max_len=None, min_cpg=2)


def regions_nx(spark, folder):
    return regions.regions_wide(_regions(spark, folder), SAMPLES)


def regions_fraction(spark, folder):
    return _rounded(regions.regions_wide(_regions(spark, folder), SAMPLES, fraction=True), *SAMPLES)


def qualify_sites(spark, folder):
    return regions.qualify_sites(tables.counts(spark, folder), 60, 4)


def cluster_sites(spark, folder):
    return regions.cluster_sites(regions.qualify_sites(tables.counts(spark, folder)))


def _split(spark, folder, version):
    sites = regions.cluster_sites(regions.qualify_sites(tables.counts(spark, folder)))
    pieces = regions.split_regions(sites, 150, 2, version)
    return regions.region_extents(pieces).withColumnRenamed("region_start", "start")


def split_regions(spark, folder):
    return _split(spark, folder, "float")


def split_regions_integer(spark, folder):
    return _split(spark, folder, "integer")


def union_samples(spark, folder):
    counts = tables.counts(spark, folder)
    parts = [counts.filter(F.col("sample") == s) for s in SAMPLES]
    return regions.union_samples(parts)


def bed_combine(spark, folder):
    out = regions.combine_bed(
        tables.counts(spark, folder),
        tables.bed(spark, folder),
        tables.genome(spark, folder),
        tables.GENOME_CHUNK,
    )
    return _rounded(out, "frac")


def interval_join(spark, folder):
    return intervals.interval_join(
        tables.counts(spark, folder), tables.bed(spark, folder)
    ).select("name", "chrom", "start", "end", "pos", "sample", "meth", "unmeth")


def interval_join_left(spark, folder):
    joined = intervals.interval_join(
        tables.counts(spark, folder), tables.bed(spark, folder), how="left"
    )
    return joined.select("name", "chrom", "start", "end", "pos", "sample", "meth", "unmeth")


def pairwise_diff(spark, folder):
    out = difftest.pairwise_diff(_regions(spark, folder), GROUPS, 0.05)
    return _rounded(out, "mu1", "mu2", "diff")


def welch_stat(spark, folder):
    out = difftest.welch_pairs(_regions(spark, folder), GROUPS).drop("pval")
    return _rounded(out, "mu1", "mu2", "diff", "t", "df")


def welch_pvalues(spark, folder):
    out = difftest.diff_meth(_regions(spark, folder), GROUPS, min_diff=0.05, max_p=0.2)
    return _rounded(out, "mu1", "mu2", "diff", "t", "df", "pval")


def ztest_stat(spark, folder):
    out = difftest.ztest_pairs(_regions(spark, folder), GROUPS).drop("pval")
    return _rounded(out, "mu1", "mu2", "diff", "z")


def ztest_pvalues(spark, folder):
    out = difftest.diff_meth(
        _regions(spark, folder), GROUPS, test="ztest", min_diff=0.02, max_p=0.05
    )
    return _rounded(out, "mu1", "mu2", "diff", "z", "pval")


def specific_diffs(spark, folder):
    rows = difftest.pairwise_diff(_regions(spark, folder), GROUPS)
    wide = rows.groupBy(*KEYS).agg(
        *[
            F.max(F.when((F.col("g1") == a) & (F.col("g2") == b), F.col("diff"))).alias(f"{a}_{b}")
            for a, b in (("A", "N"), ("A", "R"), ("N", "R"))
        ]
    )
    up = difftest.specific_diffs(wide, "up").withColumn("direction", F.lit("up"))
    down = difftest.specific_diffs(wide, "down").withColumn("direction", F.lit("down"))
    return _rounded(up.unionByName(down), "A_N", "A_R", "N_R")


def _calls(spark, folder, version="canonical"):
    return calls.cpg_calls(tables.alignments(spark, folder), version)


def cpg_calls(spark, folder):
    return _calls(spark, folder)


def cpg_calls_old(spark, folder):
    return _calls(spark, folder, "old")


def cpg_counts(spark, folder):
    return _rounded(calls.cpg_counts(_calls(spark, folder), 2), "pct")


def cpg_summary(spark, folder):
    return _rounded(calls.cpg_summary(tables.alignments(spark, folder)), "pct")


def linked_methylation(spark, folder):
    return linked.linked_methylation(
        _calls(spark, folder), tables.windows(spark, folder), conflicts="blank"
    )


def linked_sites(spark, folder):
    return linked.linked_sites(_calls(spark, folder), tables.windows(spark, folder))


def _chroms(spark, folder):
    return tables.windows(spark, folder).groupBy("chrom").agg(F.max("end").alias("length"))


def sam_to_bed(spark, folder):
    return reads.sam_to_bed(
        tables.alignments(spark, folder), _chroms(spark, folder), unpaired="extend", extend=60
    )


def sam_to_fastq(spark, folder):
    return reads.sam_to_fastq(tables.alignments(spark, folder))


def sam_to_fastq_pe(spark, folder):
    return reads.sam_to_fastq_pe(tables.alignments(spark, folder)).drop("pair")


def _names(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").filter("o_orderstatus = 'F'")
    return orders.select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("qname"))


def _listed(spark, folder, keep):
    kept = reads.filter_reads(tables.alignments(spark, folder), _names(spark, folder), keep)
    return kept.select("line_no", "qname", "flag", "rname", "pos", "cigar", "seq", "qual")


def filter_reads_keep(spark, folder):
    return _listed(spark, folder, True)


def filter_reads_drop(spark, folder):
    return _listed(spark, folder, False)


def alignments_per_read(spark, folder):
    return reads.alignments_per_read(tables.alignments(spark, folder))


def read_score(spark, folder):
    return reads.read_score(tables.alignments(spark, folder))


def _dedup(spark, folder, by):
    wanted = ["line_no", "qname", "flag", "rname", "pos", "cigar", "seq"]
    records = tables.copied_alignments(spark, folder).select(*wanted, *(["tags"] if by == "xm" else []))
    return reads.dedup_reads(records, by).select(*wanted)


def dedup_seq(spark, folder):
    return _dedup(spark, folder, "seq")


def dedup_xm(spark, folder):
    return _dedup(spark, folder, "xm")


def dedup_consensus(spark, folder):
    return _dedup(spark, folder, "consensus")


def dedup_summary(spark, folder):
    return reads.dedup_summary(tables.copied_alignments(spark, folder))


def top_sequence(spark, folder):
    return reads.top_sequence(tables.copied_alignments(spark, folder))


def dups_ranked(spark, folder):
    return duplicates.find_dups(tables.alignments(spark, folder))


def dups_input(spark, folder):
    return duplicates.find_dups(tables.alignments(spark, folder), rank="input")


def dups_picard(spark, folder):
    return duplicates.find_dups(
        tables.alignments(spark, folder), mode="picard", incomplete="drop"
    )


def dups_se(spark, folder):
    records = tables.alignments(spark, folder).withColumn(
        "qname", F.concat("qname", F.lit("#"), F.col("line_no").cast("string"))
    )
    return duplicates.find_dups(records, paired=False)


def context_quality(spark, folder):
    return _rounded(quality.context_quality(tables.alignments(spark, folder)), "bad_frac")


def base_quality(spark, folder):
    fastq = reads.sam_to_fastq(tables.alignments(spark, folder))
    return _rounded(quality.base_quality(fastq), "mean", "std")


def region_reads(spark, folder):
    return pileup.region_reads(tables.alignments(spark, folder), tables.windows(spark, folder))


def region_alignment(spark, folder):
    return pileup.region_alignment(
        tables.alignments(spark, folder),
        tables.windows(spark, folder),
        tables.genome(spark, folder),
        chunk_size=tables.GENOME_CHUNK,
    )


def region_alignment_seq(spark, folder):
    return pileup.region_alignment(
        tables.alignments(spark, folder), tables.windows(spark, folder), what="seq"
    )


def region_cpg_matrix(spark, folder):
    return pileup.region_cpg_matrix(
        tables.alignments(spark, folder), tables.windows(spark, folder)
    )


def region_cpg_summary(spark, folder):
    return pileup.region_cpg_summary(
        tables.alignments(spark, folder), tables.windows(spark, folder)
    )


def region_genome(spark, folder):
    return pileup.region_genome(
        tables.alignments(spark, folder),
        tables.windows(spark, folder),
        tables.genome(spark, folder),
        tables.GENOME_CHUNK,
    )


def cpg_motif_count(spark, folder):
    return tables.genome(spark, folder).select(
        "chrom", "chunk_no", sequence.cpg_count(F.col("seq")).alias("cpg")
    )


def _segments(spark, folder):
    bed = tables.bed(spark, folder)
    return bed.select("chrom", F.col("start").alias("pos"), (F.col("end") - F.col("start")).alias("len"))


def extract_segments(spark, folder):
    return segments.extract_segments(
        tables.genome(spark, folder), _segments(spark, folder), chunk_size=tables.GENOME_CHUNK
    )


def extract_segments_rc(spark, folder):
    return segments.extract_segments(
        tables.genome(spark, folder), _segments(spark, folder), True, tables.GENOME_CHUNK
    )


def extract_segments_indexed(spark, folder):
    """Segments read by byte from FASTA files with an index."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/fasta"
        sinks.write_fasta(tables.genome(spark, folder), path, width=96)
        index = scratch.table(sequences.fasta_index(spark, path, pieces=True), "index")
        return scratch.result(segments.extract_indexed(index, _segments(spark, folder)))


def gene_matrix(spark, folder):
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    part = spark.read.parquet(f"{folder}/part.parquet")
    half = (F.col("l_quantity").cast("bigint") * F.col("l_linenumber")) / 2
    table = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("Geneid"))
        .agg(
            F.lit("chr1").alias("Chr"),
            F.lit("1").alias("Start"),
            F.lit("2").alias("End"),
            F.lit("+").alias("Strand"),
            F.max("p_size").alias("Length"),
            *[
                F.sum(F.when(F.col("l_returnflag") == f, half)).alias(f"bam/{f}/x.bam")
                for f in ("A", "N", "R")
            ],
        )
    )
    return expression.gene_matrix(table)


def significant_genes(spark, folder):
    return expression.significant_genes(tables.gene_diff(spark, folder), exclude=["s2"])


def heatmap(spark, folder):
    return expression.heatmap(tables.gene_diff(spark, folder), "s3")


def wald_test(spark, folder):
    out = wald.find_dmrs(_regions(spark, folder), GROUPS, min_cpg=2, min_diff=0.02, max_p=0.05)
    return _rounded(out, "mu1", "mu2", "diff", "stat", "pval", "fdr")


def wald_wide(spark, folder):
    tests = wald.bh_fdr(wald.wald_pairs(_regions(spark, folder), GROUPS))
    wide = wald.dmrs_wide(tests, GROUPS, extra=("fdr",))
    return wide.select(*KEYS, *[F.round(F.col(f"`{c}`"), DIGITS).alias(c) for c in wide.columns[4:]])


def _scored(spark, folder):
    """Comparisons with a p-value that both engines can compute."""
    rows = difftest.pairwise_diff(_regions(spark, folder), GROUPS).filter(F.col("diff").isNotNull())
    return rows.withColumn("pval", F.round(1 - F.abs("diff"), 3))


def bh_fdr(spark, folder):
    return _rounded(wald.bh_fdr(_scored(spark, folder)), "mu1", "mu2", "diff", "fdr")


def dmr_filter(spark, folder):
    rows = wald.dmr_filter(_scored(spark, folder), min_cpg=3, min_passing=2, min_diff=0.02, up=True)
    return _rounded(rows, "mu1", "mu2", "diff")


def group_means(spark, folder):
    return _rounded(wald.group_means(_scored(spark, folder)), "mu")


def attach_tests(spark, folder):
    extents = regions.region_extents(
        regions.cluster_sites(regions.qualify_sites(tables.counts(spark, folder)))
    ).withColumnRenamed("region_start", "start")
    tests = _scored(spark, folder).drop("mu1", "mu2")
    return _rounded(wald.attach_tests(extents, tests), "diff")


def sites_natural_order(spark, folder):
    counts = tables.counts(spark, folder)
    key = chrom.chrom_key_natural(F.col("chrom"))
    return counts.orderBy(key, "pos", "sample").select(
        "chrom", "pos", "sample", key["number"].alias("chrom_no")
    )


def chrom_first_seen(spark, folder):
    seen = chrom.chrom_key_first_seen(
        tables.counts(spark, folder), "sample", "pos"
    )
    return seen.select("chrom", "first_seen.sample", "first_seen.pos")


def sam_roundtrip(spark, folder):
    """Alignments written as gzip SAM text and read back."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/sam.gz"
        sinks.write_sam(tables.alignments(spark, folder), None, path)
        back = alignments.read_sam(spark, path)
        return scratch.result(
            back.select(
                "qname", "flag", "rname", "pos", "cigar", "rnext", "pnext", "seq", "qual",
                sam.tag(F.col("tags"), "XM").alias("xm"),
                sam.tag(F.col("tags"), "XG").alias("xg"),
            )
        )


def counts_roundtrip(spark, folder):
    """Counts written per sample as counts files and read back."""
    counts = tables.counts(spark, folder).withColumn("pct", 100.0 * F.col("meth") / (F.col("meth") + F.col("unmeth")))
    with Scratch(spark) as scratch:
        paths = []
        for name in SAMPLES:
            path = f"{scratch.path}/{name}.cov"
            sinks.write_counts(counts.filter(F.col("sample") == name), path)
            paths.append(path)
        return scratch.result(sources.read_counts(spark, paths))


def fasta_roundtrip(spark, folder):
    """Genome written as FASTA in ranges of chromosome and offset, and read back in chunks
    of another size."""
    genome = tables.genome(spark, folder)
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/fasta"
        sinks.write_fasta(genome, path, width=96)
        return scratch.result(sequences.read_fasta(spark, path, chunk_size=100, pieces=True))


def fastq_roundtrip(spark, folder):
    """First reads written as FASTQ and read back."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/fastq"
        sinks.write_fastq(reads.sam_to_fastq(tables.alignments(spark, folder)), path)
        return scratch.result(sequences.read_fastq(spark, path))


def fastq_pe_roundtrip(spark, folder):
    """Mates written to two folders and read back by place: file number and record."""
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/fastq.gz"
        ends = scratch.table(reads.sam_to_fastq_pe(tables.alignments(spark, folder)), "ends")
        sinks.write_fastq(ends, path)
        scratch.drop("ends")

        def end(k):
            number = F.regexp_extract("file", r"part-(\d+)", 1).alias("number")
            found = sequences.read_fastq(spark, f"{path}/end={k}", places=True).select(
                number, "record", *(F.col(c).alias(f"{c}_{k}") for c in ("name", "seq", "qual"))
            )
            return scratch.table(found, f"end{k}")

        both = end(1).join(end(2), ["number", "record"], "full")
        return scratch.result(both.drop("number", "record"))


QUERIES = {
    f.__name__: f
    for f in (
        regions_nx,
        regions_fraction,
        qualify_sites,
        cluster_sites,
        split_regions,
        split_regions_integer,
        union_samples,
        bed_combine,
        interval_join,
        interval_join_left,
        pairwise_diff,
        welch_stat,
        welch_pvalues,
        ztest_stat,
        ztest_pvalues,
        specific_diffs,
        cpg_calls,
        cpg_calls_old,
        cpg_counts,
        cpg_summary,
        linked_methylation,
        linked_sites,
        sam_to_bed,
        sam_to_fastq,
        sam_to_fastq_pe,
        filter_reads_keep,
        filter_reads_drop,
        alignments_per_read,
        read_score,
        dedup_seq,
        dedup_xm,
        dedup_consensus,
        dedup_summary,
        top_sequence,
        dups_ranked,
        dups_input,
        dups_picard,
        dups_se,
        context_quality,
        base_quality,
        region_reads,
        region_alignment,
        region_alignment_seq,
        region_cpg_matrix,
        region_cpg_summary,
        region_genome,
        cpg_motif_count,
        extract_segments,
        extract_segments_rc,
        extract_segments_indexed,
        gene_matrix,
        significant_genes,
        heatmap,
        wald_test,
        wald_wide,
        bh_fdr,
        dmr_filter,
        group_means,
        attach_tests,
        sites_natural_order,
        chrom_first_seen,
        sam_roundtrip,
        counts_roundtrip,
        fasta_roundtrip,
        fastq_roundtrip,
        fastq_pe_roundtrip,
    )
}
