import math

import pytest
from pyspark.sql import functions as F

from epilane.functions import chrom, cigar, sam, sequence
from epilane.functions.checks import check_range
from epilane.functions.pvalues import normal_two_sided, t_two_sided


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,indel,expanded,ref_len,clip",
    [
        ("8M", 0, "MMMMMMMM", 8, 0),
        ("2M1D3M2I1M", -1, "MMDMMMIIM", 7, 0),
        ("3S4M", 0, "MMMM", 7, -3),
        ("2D3M", 2, "DDMMM", 5, 2),
        ("2M100N2M5H", 0, "MMMM", 104, 0),
        ("*", 0, "", 0, 0),
    ],
)
def test_cigar(spark, text, indel, expanded, ref_len, clip):
    c = F.col("c")
    assert one(spark, cigar.cigar_indel(c), c=text) == indel
    assert one(spark, cigar.cigar_expand(c), c=text) == expanded
    assert one(spark, cigar.cigar_ref_len(c), c=text) == ref_len
    assert (one(spark, cigar.cigar_clip(c), c=text) or 0) == clip


def test_splices_from_either_side(spark):
    c = F.col("c")
    text = "5M10N3M20N2M"
    assert one(spark, cigar.cigar_splices(c, F.lit(False)), c=text) == ["5-10", "18-20"]
    assert one(spark, cigar.cigar_splices(c, F.lit(True)), c=text) == ["2-20", "25-10"]


def test_unknown_operation_fails(spark):
    with pytest.raises(Exception, match="unknown CIGAR operation"):
        one(spark, cigar.cigar_ref_len(F.col("c")), c="3M2Q")


def test_gap_string(spark):
    got = one(spark, cigar.gap_string(F.col("s"), F.col("c")), s="abcdefg", c="2M3D2M1I2M")
    assert got == "ab---cdefg"


def test_sequences(spark):
    s = F.col("s")
    assert one(spark, sequence.rev_comp(s), s="AaCgTN") == "NACGTT"
    assert one(spark, sequence.rev_comp(s, "drop"), s="ACxGT") == "ACGT"
    with pytest.raises(Exception, match="unknown nucleotide"):
        one(spark, sequence.rev_comp(s), s="ACX")
    assert one(spark, sequence.phred_sum(s), s="!I5") == 0 + 40 + 20
    assert one(spark, sequence.cpg_count(s), s="CGcgCCGGc") == 3
    assert one(spark, sequence.mask_context(s), s="zZhHxX.") == "zZ....."


def test_flags_and_tags(spark):
    f = F.col("f")
    assert one(spark, sam.segment(f), f=0x80) == 1
    assert one(spark, sam.segment(f), f=0x40) == 0
    with pytest.raises(Exception, match="both first and last segment"):
        one(spark, sam.segment(f), f=0xC0)
    tags = F.array(F.lit("NM:i:1"), F.lit("XM:Z:a:z"), F.lit("XMX:Z:no"))
    assert one(spark, sam.tag(tags, "XM"), f=1) == "z"
    assert one(spark, sam.tag(tags, "HI", required=False), f=1) is None
    with pytest.raises(Exception, match="no HI tag"):
        one(spark, sam.tag(tags, "HI"), f=1)


def test_sample_names(spark):
    assert sam.sample_names(["a/x.cov", "b/x.txt", "-y.gz", "x"]) == ["x", "x-", "_y", "x--"]
    assert one(spark, sam.sample_name(F.col("p")), p="dir/s1.cov.gz") == "s1"
    assert one(spark, sam.sample_name(F.col("p"), keep_folder=True), p="dir/s1.cov") == "dir/s1"


def test_chromosome_orders(spark):
    names = ["chrX", "chr10", "2", "chr2", "MT", "chrM", "10"]
    df = spark.createDataFrame([(n,) for n in names], ["chrom"])
    got = [r.chrom for r in df.orderBy(chrom.chrom_key_natural(F.col("chrom"))).collect()]
    assert got == ["chr2", "chr10", "2", "10", "chrM", "chrX", "MT"]
    mouse = spark.createDataFrame([(n,) for n in ["chrY", "chr3", "chrM", "chrX"]], ["chrom"])
    got = [r.chrom for r in mouse.orderBy(chrom.chrom_key_mouse(F.col("chrom"))).collect()]
    assert got == ["chrM", "chr3", "chrX", "chrY"]
    order = spark.createDataFrame([(0, "b"), (1, "a")], "ord long, chrom string")
    sites = spark.createDataFrame([("a", 1), ("b", 9), ("b", 2)], "chrom string, pos long")
    got = [tuple(r) for r in chrom.order_by_chrom(sites, order).collect()]
    assert got == [("b", 2), ("b", 9), ("a", 1)]


def test_check_range():
    assert check_range("3", 1, 5) == 3
    for bad in ("x", 0, 9):
        with pytest.raises(ValueError):
            check_range(bad, 1, 5)


def test_p_values(spark):
    t = one(spark, t_two_sided(F.col("t"), F.col("d")), t=-5.422177, d=2.941176)
    assert t == pytest.approx(0.0129527, abs=2e-7)
    z = one(spark, normal_two_sided(F.col("z")), z=-3.320392)
    assert z == pytest.approx(0.000898913, abs=5e-9)  # z has six decimals
    # df=1 is Cauchy, df=2 has a closed form.
    for x in (0.0, 0.3, 1.0, 7.5, 400.0):
        got1 = one(spark, t_two_sided(F.col("t"), F.col("d")), t=x, d=1.0)
        got2 = one(spark, t_two_sided(F.col("t"), F.col("d")), t=x, d=2.0)
        assert got1 == pytest.approx(1 - 2 * math.atan(x) / math.pi, rel=1e-9, abs=1e-12)
        assert got2 == pytest.approx(1 - x / math.sqrt(2 + x * x), rel=1e-8, abs=1e-12)


def test_task_functions_need_no_package_on_the_worker(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from epilane.functions.pvalues import _incomplete_beta, log_gamma
    from epilane.operators.regions import _cut_targets

    stored = tmp_path / "functions"
    stored.write_bytes(
        cloudpickle.dumps(
            [t_two_sided.func, _incomplete_beta, _cut_targets, log_gamma]
        )
    )
    code = f"from pyspark import cloudpickle; cloudpickle.loads(open({str(stored)!r}, 'rb').read())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_quality_sums_of_batches(spark):
    """Sums made by batches are those made letter by letter; few texts go that way."""
    texts = [None, "", "I", "IIII!#", "é!", "\U0001f600a", "\x00\x7f", "a" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "q string").repartition(3)
    found = df.select(
        sequence.phred_sum(F.col("q")).alias("a"), sequence._phred_sum_by_letter(F.col("q")).alias("b")
    )
    assert all(r["a"] == r["b"] for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_reference_length_needs_no_parsed_runs(spark):
    """Reference lengths and clips come from patterns, without an array of parsed runs."""
    cases = [(None, None, 0), ("*", 0, 0), ("32M", 32, 0), ("5S27M", 32, -5), ("3D4M", 7, 3), ("3I4P5H2D", 2, 0), ("4=5X", 9, 0)]
    df = spark.createDataFrame([(c,) for c, _, _ in cases], "c string")
    found = df.select("c", cigar.cigar_ref_len(F.col("c")).alias("n"), cigar.cigar_clip(F.col("c")).alias("s"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(cases, key=str)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
