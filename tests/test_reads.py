import pytest

from epilane.operators import difftest, expression, quality, reads, segments


def test_fragments(spark, make_sam):
    seq = "A" * 50
    records = [
        {"qname": "p", "flag": 99, "pos": 101, "seq": seq},
        {"qname": "p", "flag": 147, "pos": 151, "seq": seq},
        {"qname": "d", "flag": 147, "pos": 151, "seq": seq, "cigar": "20M2D30M"},
        {"qname": "d", "flag": 99, "pos": 101, "seq": seq},
        {"qname": "lone", "flag": 99, "pos": 101, "seq": seq},
        {"qname": "u", "flag": 16, "pos": 101, "seq": seq},
        {"qname": "v", "flag": 16, "pos": 11, "seq": seq},
        {"qname": "w", "flag": 0, "pos": 191, "seq": seq},
    ]
    chroms = spark.createDataFrame([("chr1", 220)], "chrom string, length long")
    got = {r["qname"]: (r["start"], r["end"], r["clamped"]) for r in reads.sam_to_bed(make_sam(records), chroms, "extend", 100).collect()}
    assert got == {
        "p": (100, 200, False),
        "d": (100, 202, False),
        "u": (50, 150, False),
        "v": (0, 60, True),
        "w": (190, 220, True),
    }
    assert {r["qname"] for r in reads.sam_to_bed(make_sam(records)).collect()} == {"p", "d"}
    with pytest.raises(Exception, match="already analyzed"):
        reads.sam_to_bed(make_sam(records[:2] + records[:1])).collect()


def test_fastq_of_first_records(make_sam):
    records = [
        {"qname": "a", "flag": 256, "seq": "TTTT"},
        {"qname": "a", "flag": 16, "seq": "AACG", "qual": "!I5A"},
        {"qname": "a", "flag": 0, "seq": "GGGG"},
    ]
    assert [tuple(r) for r in reads.sam_to_fastq(make_sam(records)).collect()] == [("a", "CGTT", "A5I!")]


def pe_model(records):
    """End of every written record, one read name at a time."""
    names = {}
    for r in records:
        if not r["flag"] & 0x900:
            names.setdefault(r["qname"], []).append(r)
    out = []
    for rows in names.values():
        waiting = None
        for r in rows:
            if not r["flag"] & 2:
                out.append(("unpaired", r["line_no"]))
                break
            if waiting and (waiting["pos"], waiting["pnext"]) == (r["pnext"], r["pos"]):
                out += [("1", waiting["line_no"]), ("2", r["line_no"])]
                waiting = None
                break
            waiting = r
        if waiting:
            out.append(("orphan", waiting["line_no"]))
    return sorted(out)


def test_fastq_pairs_follow_file_order(make_sam):
    import random

    rng = random.Random(4)
    records = []
    for i in range(300):
        a, b = rng.choice([(1, 5), (5, 1), (1, 9)])
        records.append(
            {
                "line_no": i, "qname": f"r{rng.randint(0, 59)}", "flag": rng.choice([3, 3, 3, 1, 259]),
                "pos": a, "pnext": b, "seq": "ACGT"[i % 4] * 3 + "A" * (i // 4 % 7), "qual": f"{i:010d}",
            }
        )
    got = sorted((r["end"], int(r["qual"])) for r in reads.sam_to_fastq_pe(make_sam(records)).collect())
    assert got == pe_model(records)
    names = {r["end"]: r["name"] for r in reads.sam_to_fastq_pe(make_sam(records)).collect()}
    assert names["1"].endswith(" /1") and names["2"].endswith(" /2") and " " not in names["unpaired"]


def test_copies(make_sam):
    records = [
        {"seq": "ACGT", "tags": ["XM:Z:z..."]},
        {"seq": "ACGT", "tags": ["XM:Z:Z..."]},
        {"seq": "TTTT", "tags": ["XM:Z:z..."]},
        {"seq": "TTTT", "tags": ["XM:Z:z..."]},
        {"seq": "GGGG", "flag": 16, "pos": 96, "tags": ["XM:Z:z..."]},
        {"seq": "ACGT", "flag": 4, "tags": ["XM:Z:z..."]},
    ]
    sam = make_sam(records)

    def kept(by, **more):
        return sorted(r["line_no"] for r in reads.dedup_reads(sam, by, **more).collect())

    assert kept("seq") == [0, 2, 4]
    assert kept("xm") == [0, 1, 4]
    assert kept("consensus") == [0, 4]
    assert kept("seq", keep_unmapped=True) == [0, 2, 4]
    assert tuple(reads.dedup_summary(sam).first()) == (5, 2, 1, 2)


def test_read_filters_and_counts(spark, make_sam):
    sam = make_sam([{"qname": "a", "flag": 64}, {"qname": "a", "flag": 128}, {"qname": "b"}])
    names = spark.createDataFrame([("a",), ("a",), ("z",)], "qname string")
    assert reads.filter_reads(sam, names).count() == 2
    assert [r["qname"] for r in reads.filter_reads(sam, names, keep=False).collect()] == ["b"]
    got = {r["qname"]: (r["first"], r["last"]) for r in reads.alignments_per_read(sam).collect()}
    assert got == {"a": (1, 1), "b": (1, 0)}


def test_quality(spark, make_sam):
    sam = make_sam([{"seq": "AAAA", "qual": "I!I!", "tags": ["XM:Z:zzZh"]}])
    got = {r["context"]: (r["bad"], r["good"], r["bad_frac"]) for r in quality.context_quality(sam).collect()}
    assert got["z"] == (1, 1, 0.5) and got["Z"] == (0, 1, 0.0) and got["X"] == (0, 0, None) and len(got) == 6
    fq = spark.createDataFrame([("r", "AAC", "!I5")], "name string, seq string, qual string")
    got = {r["base"]: (r["mean"], r["std"], r["n"]) for r in quality.base_quality(fq).collect()}
    assert got == {"A": (20.0, 20.0, 2), "C": (20.0, 0.0, 1)}
    bad = spark.createDataFrame([("r", "AX", "!!")], "name string, seq string, qual string")
    with pytest.raises(Exception, match="unknown base"):
        quality.base_quality(bad).collect()


def region_rows(spark, values):
    rows = [("c", 1, 9, 3, s, float(n), float(x)) for s, (n, x) in values.items()]
    return spark.createDataFrame(rows, "chrom string, start long, end long, cpg long, sample string, n double, x double")


def test_welch_and_its_special_cases(spark):
    groups = {"g1": ["a", "b", "c"], "g2": ["d", "e", "f"]}
    df = region_rows(spark, {"a": (1, 0.1), "b": (1, 0.2), "c": (1, 0.15), "d": (1, 0.5), "e": (1, 0.4), "f": (1, 0.6)})
    row = difftest.welch_pairs(df, groups).first()
    assert row["diff"] == pytest.approx(0.35)
    assert row["t"] == pytest.approx(-5.422177, abs=1e-6)
    assert row["df"] == pytest.approx(2.941176, abs=1e-6)
    assert row["pval"] == pytest.approx(0.0129527, abs=1e-7)

    def p(values, g1, g2):
        return difftest.welch_pairs(region_rows(spark, values), {"g1": g1, "g2": g2}).first()["pval"]

    assert p({"a": (1, 0.1), "d": (1, 0.5), "e": (1, 0.4)}, ["a"], ["d", "e"]) is None
    assert p({"a": (1, 0.25), "b": (1, 0.75), "d": (1, 0.5), "e": (1, 0.5)}, ["a", "b"], ["d", "e"]) == 1
    assert p({"a": (1, 0.2), "b": (1, 0.2), "d": (1, 0.5), "e": (1, 0.5)}, ["a", "b"], ["d", "e"]) == 0


def test_z_test(spark):
    df = region_rows(spark, {"a": (30, 20), "b": (20, 10), "c": (40, 10)})
    row = difftest.ztest_pairs(df, {"g1": ["a", "b"], "g2": ["c"]}).first()
    assert (row["diff"], row["z"]) == (pytest.approx(-0.35), pytest.approx(-3.320392, abs=1e-6))
    assert row["pval"] == pytest.approx(0.000898913, abs=1e-9)
    same = region_rows(spark, {"a": (5, 5), "b": (3, 3)})
    assert difftest.ztest_pairs(same, {"g1": ["a"], "g2": ["b"]}).first()["pval"] == 1


def test_reporting_rules(spark):
    groups = {"g1": ["a", "b"], "g2": ["d", "e"], "g3": ["z"]}
    df = region_rows(spark, {"a": (1, 0.1), "b": (1, 0.2), "d": (1, 0.5), "e": (1, 0.4)})
    assert difftest.diff_meth(df, groups).count() == 3
    assert difftest.diff_meth(df, groups, down=True).count() == 0
    assert difftest.diff_meth(df, groups, up=True, min_diff=0.2).count() == 3
    assert difftest.diff_meth(df, groups, max_p=0.001).count() == 0
    assert difftest.diff_meth(df, groups, max_p=0.001, keep_na_diff=True, keep_na_p=True).count() == 3
    assert difftest.diff_meth(df, groups, min_cpg=4).count() == 0
    assert difftest.diff_meth(df, groups, test="none", min_diff=0.29).count() == 3
    with pytest.raises(ValueError, match="listed twice"):
        difftest.diff_meth(df, {"g1": ["a"], "g2": ["a"]})


def test_specific_differences(spark):
    rows = [("r1", 0.2, 0.05, 0.0), ("r2", 0.2, 0.1, 0.0), ("r3", -0.2, 0.0, 0.0), ("r4", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "name string, d1 double, d2 double, d3 double")
    assert [r["name"] for r in difftest.specific_diffs(df, "up").collect()] == ["r1"]
    assert [r["name"] for r in difftest.specific_diffs(df, "down").collect()] == ["r3"]


def test_expression_tables(spark):
    inf = float("inf")
    rows = [
        ("g1", "b", "x", "OK", 2.0, "yes"),
        ("g1", "y", "b", "OK", inf, "no"),
        ("g1", "x", "y", "OK", -3.5, "yes"),
        ("g2", "b", "x", "NOTEST", 1.0, "no"),
        ("g3", "b", "x", "NOTEST", 9.0, "yes"),
        ("g3", "y", "b", "OK", 0.0, "no"),
    ]
    diff = spark.createDataFrame(rows, "gene string, sample_1 string, sample_2 string, status string, fold double, significant string")
    long = {(r["gene"], r["sample_1"], r["sample_2"]): r["value"] for r in expression.significant_genes(diff).collect()}
    assert len(long) == 5 and long[("g3", "b", "x")] == 0.0
    got = {r["gene"]: (r["x"], r["y"]) for r in expression.order_genes(expression.heatmap(diff, "b")).collect()}
    assert got == {"g1": (2.0, -9.0), "g3": (0.0, 0.0)}
    assert {r["gene"] for r in expression.significant_genes(diff, exclude=["x"]).collect()} == set()
    with pytest.raises(ValueError, match="not found"):
        expression.heatmap(diff, "nobody")


def test_segments(spark):
    genome = spark.createDataFrame([("c", 0, 0, "acgt"), ("c", 1, 4, "ttga")], "chrom string, chunk_no long, offset long, seq string")
    wanted = spark.createDataFrame([("c", 2, 4), ("c", 6, 5), ("d", 0, 2)], "chrom string, pos long, len long")
    got = {(r["chrom"], r["pos"]): (r["seq"], r["past_end"]) for r in segments.extract_segments(genome, wanted, chunk_size=4).collect()}
    assert got == {("c", 2): ("GTTT", False), ("c", 6): ("GA", True), ("d", 0): (None, None)}
    got = {r["pos"]: r["seq"] for r in segments.extract_segments(genome, wanted, True, 4).collect() if r["chrom"] == "c"}
    assert got == {2: "AAAC", 6: "TC"}
