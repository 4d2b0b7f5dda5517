"""Long names, unlearnable priors, mates in step, records and rows that must not matter."""

import glob

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from epilane.functions import chrom
from epilane.functions.pvalues import normal_two_sided
from epilane.operators import pileup, reads, regions, segments, wald
from epilane.sources import sequences, sinks

LONG = "n" * 100_050


def test_long_sequence_names_stay_whole(spark, tmp_path):
    (tmp_path / "a.fa").write_text(f">{LONG}a x\nACGT\n>{LONG}b\nGGGG\n")
    rows = sequences.read_fasta(spark, str(tmp_path / "a.fa")).collect()
    assert {(r["chrom"], r["seq"]) for r in rows} == {(LONG + "a", "ACGT"), (LONG + "b", "GGGG")}
    (tmp_path / "a.fq").write_text(f"@{LONG}\nAC\n+\nII\n")
    assert sequences.read_fastq(spark, str(tmp_path / "a.fq")).first()["name"] == LONG


def test_long_chromosome_names_sort_to_the_end(spark):
    names = [f"chr{'x' * 1000}b", f"chr{'x' * 1000}a", "chr2", "chr10"]
    df = spark.createDataFrame([(n,) for n in names], "chrom string")
    got = [r["chrom"] for r in df.orderBy(chrom.chrom_key_natural(F.col("chrom"))).collect()]
    assert got == ["chr2", "chr10", names[1], names[0]]


def test_a_prior_that_cannot_be_learnt_fails(spark):
    rows = [("c", 1, 9, 3, s, 40, 10) for s in "abcd"]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, cpg long, sample string, n long, x long")
    groups = {"g": ["a", "b"], "h": ["c", "d"]}
    with pytest.raises(PySparkException, match="no prior can be learnt"):
        wald.wald_pairs(df, groups).collect()
    assert wald.wald_pairs(df, groups, prior=(-3.0, 1.0)).first()["pval"] == 1


def test_dispersion_at_the_edge_is_told(spark):
    rows = [("c", 1, 9, 3, s, 1000, x) for s, x in zip("abcd", (10, 990, 500, 500), strict=True)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, cpg long, sample string, n long, x long")
    groups = {"g": ["a", "b"], "h": ["c", "d"]}
    row = wald.wald_pairs(df, groups, prior=(-1.0, 5.0), log_range=(-4.0, -3.0)).first()
    assert row["at_edge"]


def test_normal_tail_to_double_precision(spark):
    import math

    values = [0.0, 1e-9, 0.5, 1.0, 1.96, 3.3, 7.0, 20.0, 36.0]
    df = spark.createDataFrame([(v,) for v in [*values, -2.0, float("nan"), None]], "z double")
    got = [r["p"] for r in df.select(normal_two_sided("z").alias("p")).collect()]
    for v, p in zip(values, got, strict=False):
        assert p == pytest.approx(math.erfc(v / math.sqrt(2)), rel=1e-12)
    assert got[-3] == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-12)
    assert got[-2:] == [None, None]


@pytest.mark.parametrize("with_pair", [True, False])
def test_mates_stand_in_step_over_several_files(spark, make_sam, tmp_path, with_pair):
    records = []
    for i in range(400):
        name = f"r{(i * 7919) % 400}"
        records.append({"qname": name, "flag": 99, "pos": 10, "pnext": 50, "rnext": "="})
        records.append({"qname": name, "flag": 147, "pos": 50, "pnext": 10, "rnext": "="})
    ends = reads.sam_to_fastq_pe(make_sam(records))
    if not with_pair:
        ends = ends.drop("pair")
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_fastq(ends, str(tmp_path / "fq"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)

    def names(end):
        files = sorted(glob.glob(f"{tmp_path}/fq/end={end}/part-*"))
        return [[line.split()[0] for line in open(f).read().split("\n")[::4] if line] for f in files]

    first, second = names(1), names(2)
    assert len(first) > 1 and first == second and sum(map(len, first)) == 400


def test_records_off_the_regions_need_no_calls(spark, make_sam):
    sam = make_sam(
        [
            {"qname": "a", "pos": 100, "tags": ["XM:Z:zzZZ......"]},
            {"qname": "far", "pos": 5000},
            {"qname": "unmapped", "flag": 4, "pos": 0, "cigar": "*", "rname": "*"},
        ]
    )
    bed = spark.createDataFrame([("w", "chr1", 95, 120)], "name string, chrom string, start long, end long")
    assert [r["qname"] for r in pileup.region_reads(sam, bed).collect()] == ["a"]


def test_a_region_given_twice_has_its_rows_twice(spark):
    counts = spark.createDataFrame([("c", 5, "s", 3, 1)], "chrom string, pos long, sample string, meth long, unmeth long")
    bed = spark.createDataFrame([("c", 2, 9, "x"), ("c", 2, 9, "y"), ("c", 50, 60, "z")], "chrom string, start long, end long, name string")
    rows = regions.combine_bed(counts, bed).collect()
    assert sorted((r["start"], r["sample"]) for r in rows if r["sample"]) == [(1, "s"), (1, "s")]
    assert sum(r["sample"] is None for r in rows) == 1


def test_a_position_with_two_rows_of_a_sample_fails(spark):
    rows = [("c", 5, "s", 30, 1), ("c", 5, "s", 30, 30), ("c", 9, "s", 9, 1), ("c", 12, "s", 9, 1)]
    counts = spark.createDataFrame(rows, "chrom string, pos long, sample string, meth long, unmeth long")
    with pytest.raises(PySparkException, match="more than one row"):
        regions.combine_regions(counts).collect()
    assert regions.combine_regions(counts.filter("unmeth < 30")).count() == 1


def test_genome_text_is_spread_and_not_broadcast(spark, tmp_path):
    """Chunks made from a small table come from several tasks and meet intervals by shuffle."""
    from epilane.operators.intervals import slice_genome
    from epilane.plans import tables

    spark.range(200).selectExpr("id as p_partkey", "1 as p_size").coalesce(1).write.parquet(
        str(tmp_path / "part.parquet")
    )
    genome = tables.genome(spark, str(tmp_path))
    assert genome.rdd.getNumPartitions() > 1
    text = slice_genome(tables.bed(spark, str(tmp_path)), genome, tables.GENOME_CHUNK)
    plan = text._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "chunk_no" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_genome_text_is_made_once_for_segments(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    chunks = [("a", i, i * 4, t) for i, t in enumerate(("ACGT", "ggTA", "C"))] + [("b", 0, 0, "TT")]
    genome = spark.createDataFrame(
        spark.sparkContext.parallelize(chunks, 2).map(counted), "chrom string, chunk_no long, offset long, seq string"
    )
    wanted = spark.createDataFrame([("a", 2, 5), ("a", 7, 2), ("b", 0, 1), ("c", 0, 1)], "chrom string, pos long, len long")
    rows = segments.extract_segments(genome, wanted, chunk_size=4).collect()
    assert {(r["chrom"], r["pos"], r["seq"], r["past_end"]) for r in rows} == {
        ("a", 2, "GTGGT", False), ("a", 7, "AC", True), ("b", 0, "T", False), ("c", 0, None, None)
    }
    assert seen.value == len(chunks)
