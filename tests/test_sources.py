import gzip

import pytest
from pyspark.sql import functions as F

from epilane.operators import calls, regions, wald
from epilane.sources import alignments, sequences, sinks, tables
from epilane.streaming.counts import stream_cpg_counts, stream_sam

HEADER = "@HD\tVN:1.0\tSO:coordinate\n@SQ\tSN:chr2\tLN:500\n@SQ\tSN:chr1\tLN:90\n@PG\tID:x\n"


def record(name, flag=0, pos=10, xm="z...Z", more=""):
    return f"{name}\t{flag}\tchr1\t{pos}\t60\t5M\t*\t0\t0\tACGTA\tIIIII\tXM:Z:{xm}\tXG:Z:CT{more}\n"


def write(path, text):
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def read_text(folder):
    lines = []
    for part in sorted(folder.glob("part-*")):
        data = gzip.decompress(part.read_bytes()) if part.suffix == ".gz" else part.read_bytes()
        lines += data.decode().splitlines()
    return lines


@pytest.mark.parametrize("name", ["in.sam", "in.sam.gz"])
def test_sam(spark, tmp_path, name):
    path = write(tmp_path / name, HEADER + record("a") + "\n" + record("b", 16, 12, more="\tHI:i:3"))
    rows = alignments.read_sam(spark, path).orderBy("line_no").collect()
    assert [(r["qname"], r["flag"], r["pos"], r["cigar"]) for r in rows] == [("a", 0, 10, "5M"), ("b", 16, 12, "5M")]
    assert rows[1]["tags"] == ["XM:Z:z...Z", "XG:Z:CT", "HI:i:3"]
    header = alignments.read_sam_header(spark, path).orderBy("ord").collect()
    assert [(r["chrom"], r["length"]) for r in header] == [("chr2", 500), ("chr1", 90)]
    assert alignments.is_coordinate_sorted(spark, path).first()[0] is True


def test_short_records(spark, tmp_path):
    path = write(tmp_path / "x.sam", HEADER + record("a") + "b\t0\tchr1\n")
    with pytest.raises(Exception, match="wrong number of fields in SAM record"):
        alignments.read_sam(spark, path).collect()
    assert alignments.read_sam(spark, path, mode="permissive").count() == 1
    assert [r["line"] for r in alignments.rejected_sam(spark, path).collect()] == ["b\t0\tchr1"]
    no_tags = write(tmp_path / "y.sam", "a\t0\tc\t1\t0\t1M\t*\t0\t0\tA\tI\n")
    assert alignments.read_sam(spark, no_tags).first()["tags"] == []
    with pytest.raises(Exception, match="wrong number of fields"):
        alignments.read_sam(spark, no_tags, min_fields=12).collect()


@pytest.mark.parametrize("out", ["kept", "kept.gz"])
def test_sam_is_written_in_order(spark, tmp_path, out):
    path = write(tmp_path / "x.sam", HEADER + "".join(record(f"r{i}") for i in range(40)))
    df = alignments.read_sam(spark, path)
    sinks.write_sam(df.repartition(5), alignments.read_header_lines(spark, path), str(tmp_path / out))
    assert read_text(tmp_path / out) == (tmp_path / "x.sam").read_text().splitlines()


def test_counts_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("c", 5, 1, 511, 100.0 / 512), ("c", 9, 3, 0, 100.0)], "chrom string, pos long, meth long, unmeth long, pct double"
    )
    expected = {
        "end-pct": ["c\t5\t6\t0.195312\t1\t511", "c\t9\t10\t100.000000\t3\t0"],
        "strand-pct": ["c\t5\t+\t0.195312\t1\t511", "c\t9\t+\t100.000000\t3\t0"],
        "end-strand": ["c\t5\t6\t+\t1\t511", "c\t9\t10\t+\t3\t0"],
    }
    for layout, lines in expected.items():
        sinks.write_counts(df, str(tmp_path / layout), layout)
        assert sorted(read_text(tmp_path / layout)) == lines
    one = write(tmp_path / "s1.cov.gz", "\n".join(expected["end-pct"]) + "\n")
    two = write(tmp_path / "s2.cov", "\n".join(expected["end-strand"]) + "\n")
    got = sorted(tuple(r) for r in tables.read_counts(spark, [one, two]).collect())
    assert got == [(n, "c", p, m, u) for n in ("s1", "s2") for p, m, u in ((5, 1, 511), (9, 3, 0))]
    (tmp_path / "d").mkdir()
    again = write(tmp_path / "d" / "s2.cov", "c\t1\t2\t+\t1\t1\n")
    assert {r["sample"] for r in tables.read_counts(spark, [two, again]).collect()} == {"s2", "s2-"}
    with pytest.raises(Exception):
        tables.read_counts(spark, [write(tmp_path / "bad.cov", "c\t1\t2\n")]).collect()


def test_bed_modes(spark, tmp_path):
    path = write(tmp_path / "a.bed", "c\t1\t5\tx\nc\t2\t6\ty\textra\n")
    got = sorted(tuple(r) for r in tables.read_bed(spark, path).collect())
    assert got == [("c", 1, 5, "x"), ("c", 2, 6, "y")]
    with pytest.raises(Exception, match="repeated BED region name"):
        tables.read_bed(spark, write(tmp_path / "b.bed", "c\t1\t5\tx\nc\t2\t6\tx\n")).collect()
    with pytest.raises(Exception, match="fields in BED"):
        tables.read_bed(spark, write(tmp_path / "c.bed", "c\t1\t5\n")).collect()
    with pytest.raises(Exception, match="fields in BED"):
        tables.read_bed(spark, path, "three").collect()
    mixed = write(tmp_path / "d.bed", "c\t1\t5\nc\t9\nc\t2\t6\tx\nc\t3\t7\nc\t4\t8\tx\n")
    got = sorted(tuple(r) for r in tables.read_bed(spark, mixed, "numbered").collect())
    assert got == [("c", 1, 5, "0"), ("c", 2, 6, "x"), ("c", 3, 7, "1")]


@pytest.mark.parametrize("chunk", [4, 1000])
def test_fasta(spark, tmp_path, chunk):
    text = ">one first\nACGTA\nCCg\n\n>two\nTTTTTTTTT\n>three\nA\n"
    path = write(tmp_path / "g.fa", text)
    rows = sequences.read_fasta(spark, path, chunk_size=chunk).orderBy("chrom", "chunk_no").collect()
    whole = {}
    for r in rows:
        assert r["offset"] == r["chunk_no"] * chunk == len(whole.get(r["chrom"], ""))
        whole[r["chrom"]] = whole.get(r["chrom"], "") + r["seq"]
    assert whole == {"one": "ACGTACCg", "two": "TTTTTTTTT", "three": "A"}
    named = sequences.read_fasta(spark, path, name="line")
    assert {r["chrom"] for r in named.collect()} == {"one first", "two", "three"}


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{i} x\n{'ACGTN'[i % 5] * 3}\n+\n@I{i % 10}\n" for i in range(50))
    path = write(tmp_path / "r.fastq.gz", text)
    got = sorted(tuple(r) for r in sequences.read_fastq(spark, path).collect())
    assert got == sorted((f"r{i} x", "ACGTN"[i % 5] * 3, f"@I{i % 10}") for i in range(50))
    df = spark.createDataFrame([("1", "a /1", "AC", "II"), ("2", "a /2", "GT", "II")], "end string, name string, seq string, qual string")
    sinks.write_fastq(df, str(tmp_path / "out"))
    assert read_text(tmp_path / "out" / "end=2") == ["@a /2", "GT", "+", "II"]


def test_region_tables(spark, tmp_path):
    path = write(
        tmp_path / "r.txt",
        "chr\tstart\tend\tCpG\tgene\ta-N\ta-X\tb-N\tb-X\nc\t1\t9\t3\tG\t10\t4\tNA\tNA\nc\t20\t29\t2\tH\t1\t1\t8\t2\n",
    )
    got = sorted(tuple(r) for r in tables.read_regions(spark, path, {"g": ["a"], "h": ["b"]}, keep=["gene"]).collect())
    assert got == [("c", 1, 9, 3, "G", "a", 10, 4), ("c", 20, 29, 2, "H", "a", 1, 1), ("c", 20, 29, 2, "H", "b", 8, 2)]
    with pytest.raises(ValueError, match="no column for sample z"):
        tables.read_regions(spark, path, ["z"])
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_regions(spark, path, ["a"], keep=["nope"])
    wide = regions.regions_wide(tables.read_regions(spark, path, ["a", "b"]), ["a", "b"], fraction=True)
    sinks.write_regions(wide.orderBy("start").coalesce(1), str(tmp_path / "w"))
    assert read_text(tmp_path / "w") == [
        "chr\tstart\tend\tCpG\ta\tb",
        "c\t1\t9\t3\t0.400000\tNA",
        "c\t20\t29\t2\t1.000000\t0.250000",
    ]
    back = tables.read_regions(spark, str(tmp_path / "w"), ["a", "b"])
    assert sorted((r["start"], r["sample"], r["x"] / r["n"]) for r in back.collect()) == [
        (1, "a", 0.4), (20, "a", 1.0), (20, "b", 0.25)
    ]


def test_expression_files(spark, tmp_path):
    from epilane.operators.expression import gene_matrix

    path = write(tmp_path / "fc", "# made by\nGeneid\tChr\tStart\tEnd\tStrand\tLength\td/s1/x.bam\td/s2/x.bam\nA\t1\t1\t2\t+\t99\t2.5\t-2.5\n")
    row = gene_matrix(tables.read_feature_counts(spark, path)).first()
    assert row.asDict() == {"Symbol": "A", "Length": 99, "s1": 3, "s2": -3}
    head = "id\tg\tgene\tlocus\tsample_1\tsample_2\tstatus\tv1\tv2\tlog2(fold_change)\tt\tp\tq\tsignificant\n"
    row1 = "G\t-\t-\t-\ta\tb\tOK\t1\t2\t-inf\t0\t0\t0\tyes\n"
    got = tables.read_gene_diff(spark, write(tmp_path / "d", head + row1)).first()
    assert tuple(got) == ("G", "a", "b", "OK", float("-inf"), "yes")
    with pytest.raises(ValueError, match="not a table of gene comparisons"):
        tables.read_gene_diff(spark, write(tmp_path / "e", head.replace("status", "x") + row1))


def test_lists_and_reports(spark, tmp_path):
    names = tables.read_names(spark, write(tmp_path / "n", "a\tx\nb\n"))
    assert [r["qname"] for r in names.collect()] == ["a", "b"]
    order = tables.read_chrom_order(spark, write(tmp_path / "o", "c2,c1\nc3\n"))
    assert [r["chrom"] for r in order.orderBy("ord").collect()] == ["c2", "c1", "c3"]
    sinks.write_chrom_order(order, str(tmp_path / "oo"))
    assert read_text(tmp_path / "oo") == ["c2", "c1", "c3"]
    dups = spark.createDataFrame([("q", "aln:('c', 1, (), '+')", "p", "single-end")], "qname string, aln string, parent string, type string")
    sinks.write_dups(dups, str(tmp_path / "dd"))
    assert read_text(tmp_path / "dd") == ["q\taln:('c', 1, (), '+')\tp\tsingle-end"]
    bed = spark.createDataFrame([("c", 1, 5, "q", True)], "chrom string, start long, end long, qname string, clamped boolean")
    sinks.write_bed(bed, str(tmp_path / "bb.gz"))
    assert read_text(tmp_path / "bb.gz") == ["c\t1\t5\tq"]
    linked = spark.createDataFrame(
        [("a", "c", 1, 9, 2, "r1", "0-"), ("b", "c", 20, 29, 0, None, "<none>")],
        "name string, chrom string, start long, end long, sites long, qname string, pattern string",
    )
    sites = spark.createDataFrame([("a", 7, 1), ("a", 3, 0)], "name string, pos long, idx long")
    sinks.write_linked(linked, sites, str(tmp_path / "ll"))
    assert read_text(tmp_path / "ll") == [
        "Region: a, c:1-9", "Sites: 3, 7", "0-\tr1", "", "Region: b, c:20-29", "Sites: <none>", "",
    ]
    rows = [("c", 1, 9, 3, "g1", "g2", 0.123456789, 0.4, 0.3, None)]
    tests = spark.createDataFrame(rows, "chrom string, start long, end long, cpg long, g1 string, g2 string, mu1 double, mu2 double, diff double, pval double")
    sinks.write_dmrs(wald.dmrs_wide(tests, {"g1": [], "g2": []}), str(tmp_path / "mm"))
    assert read_text(tmp_path / "mm") == [
        "chr\tstart\tend\tCpG\tg1:mu\tg2:mu\tg1->g2:diff\tg1->g2:pval", "c\t1\t9\t3\t0.1234568\t0.4\t0.3\tNA",
    ]


def test_run_summary(spark, tmp_path):
    path = write(tmp_path / "x.sam", HEADER + record("a") + record("b", 256))
    sam = alignments.read_sam(spark, path)
    got = {r["item"]: r["value"] for r in sinks.run_summary(sam, calls.cpg_summary(sam)).collect()}
    assert got == {
        "records": 2, "not_primary": 1, "reads": 1, "mapped": 1, "calls": 2, "methylated": 1, "unmethylated": 1, "pct": 50,
    }


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.sam", HEADER + record("a") + record("b", 0, 12))
    counts = stream_cpg_counts(stream_sam(spark, str(folder)))
    query = (
        counts.writeStream.outputMode("complete").format("memory").queryName("site_counts")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    try:
        query.processAllAvailable()
        write(folder / "b.sam", record("c") + record("d", 4, xm="....."))
        query.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("site_counts").collect())
    finally:
        query.stop()
    batch = calls.cpg_counts(calls.cpg_calls(alignments.read_sam(spark, str(folder))))
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) == 4


def test_lines_are_trimmed_as_by_pattern(spark, tmp_path):
    """Only lines that end in blanks go through the pattern."""
    from epilane.sources.lines import numbered_lines

    rows = ["a", "a\t", "a \t ", "", " ", "a\t ", "a\u0085", "a\t\u0085 ", "\ta b"]
    path = tmp_path / "lines.txt"
    path.write_text("\n".join(rows) + "\n", encoding="utf-8", newline="\n")
    lines = numbered_lines(spark, str(path))
    found = [r["line"] for r in lines.orderBy("line_no").collect()]
    whole = spark.read.text(str(path)).select(F.rtrim(F.regexp_replace("value", r"[\r\t ]+$", "")).alias("line"))
    assert found == [r["line"] for r in whole.collect()]
    plan = lines._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "case when" in plan and "endswith" in plan
