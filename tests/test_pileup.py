import random
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import functions as F

from epilane.operators import intervals, pileup


BASE = 10**6  # sorts after the insertion columns of its position


def cells(read, text):
    """Characters of a read by column, a column being (position, insertion index)."""
    out, at, ref = {}, 0, read["pos"]
    inserted = Counter()
    for n, op in re.findall(r"(\d+)([MID])", read["cigar"]):
        for _ in range(int(n)):
            if op == "I":
                out[(ref, inserted[ref])] = text[at]
                inserted[ref] += 1
            else:
                out[(ref, BASE)] = "-" if op == "D" else text[at]
                ref += 1
            at += op != "D"
    return out


def layout(reads, what):
    """All columns of a region in order, and the text of every read over them."""
    filled = {r["line_no"]: cells(r, r[what]) for r in reads}
    low, top = min(r["pos"] for r in reads), max(r["loc3"] for r in reads)
    columns = sorted({c for f in filled.values() for c in f} | {(p, BASE) for p in range(low, top)})
    lines = {}
    for line, f in filled.items():
        first, last = columns.index(min(f)), columns.index(max(f))
        lines[line] = " " * first + "".join(f.get(c, "-") for c in columns[first : last + 1])
    return columns, lines


def matrix_model(reads):
    """Sites and marks read off the finished layout."""
    low, top = min(r["pos"] for r in reads), max(r["loc3"] for r in reads)
    columns, lines = layout(reads, "xm")
    under_genome = [c for c in columns if c <= (top - 1, BASE)]
    called = [
        i for i in range(len(under_genome)) if any(t[i : i + 1] in ("z", "Z") for t in lines.values())
    ]
    gaps = list(accumulate(int(j < BASE and p > low) for p, j in under_genome))
    sites = []
    for i in called:
        if sites and len(sites[-1]) == 1 and sites[-1][0] == i - 1:
            sites[-1].append(i)
        else:
            sites.append([i])
    names = [f"{s[0] + low - gaps[s[0]]}" + ("+1" if len(s) == 2 else "") for s in sites]
    summary = {name: [0, 0] for name in names}
    patterns = {}
    for line, text in lines.items():
        marks = []
        for site, name in zip(sites, names):
            seen = "".join(text[i : i + 1] or "$" for i in site)  # $ is past the end
            call = re.match(r"[^zZ$]?([zZ])", seen)
            if seen[0] == "$" or seen[-1] == " ":
                marks.append("-")
            elif call:
                marks.append("01"[call.group(1) == "Z"])
                summary[name][call.group(1) == "z"] += 1
            else:
                marks.append("-" if "$" in seen else "x")
        patterns[line] = "".join(marks)
    return patterns, summary


def random_reads(rng, n):
    reads = []
    for i in range(n):
        ops = [f"{rng.randint(1, 4)}{rng.choice('MMMI')}", f"{rng.randint(1, 6)}M"]
        for _ in range(rng.randint(0, 3)):
            ops += [f"{rng.randint(1, 3)}{rng.choice('ID')}", f"{rng.randint(1, 5)}M"]
        if rng.random() < 0.2:
            ops.append(f"{rng.randint(1, 2)}I")
        cigar = "".join(ops)
        size = {o: sum(int(k) for k, op in re.findall(r"(\d+)([MID])", cigar) if op == o) for o in "MID"}
        xm = "".join(rng.choice("zZ.hX..") for _ in range(size["M"] + size["I"]))
        pos = rng.randint(20, 40)
        reads.append(
            {
                "line_no": i, "qname": f"q{i}", "pos": pos, "cigar": cigar, "xm": xm,
                "seq": xm.upper().replace(".", "A").replace("Z", "C"),
                "loc3": pos + size["M"] + size["D"], "tags": [f"XM:Z:{xm}", "XG:Z:CT"],
            }
        )
    return reads


def test_layout_and_matrix_match_the_model(spark, make_sam):
    rng = random.Random(2)
    records, beds, wanted = [], [], {}
    for k in range(12):
        reads = random_reads(rng, rng.randint(1, 9))
        for r in reads:
            r["rname"] = f"c{k}"
            r["line_no"] += 100 * k
        records += reads
        beds.append((f"c{k}", 1, 400, f"reg{k}"))
        wanted[f"reg{k}"] = reads
    sam = make_sam(records)
    bed = spark.createDataFrame(beds, "chrom string, start long, end long, name string")
    for what in ("xm", "seq"):
        got = {}
        for r in pileup.region_alignment(sam, bed, what=what).collect():
            got.setdefault(r["name"], {})[r["line_no"]] = " " * r["pad"] + r["text"]
        for name, reads in wanted.items():
            lanes = layout(reads, what)[1]
            if what == "xm":
                lanes = {k: re.sub("[hHxX]", ".", v) for k, v in lanes.items()}
            assert got[name] == lanes
    patterns, summary = {}, {}
    for r in pileup.region_cpg_matrix(sam, bed).collect():
        patterns.setdefault(r["name"], {})[r["line_no"]] = r["pattern"]
    for r in pileup.region_cpg_summary(sam, bed).collect():
        summary.setdefault(r["name"], {})[r["site"]] = [r["meth"], r["unmeth"]]
    for name, reads in wanted.items():
        want_patterns, want_summary = matrix_model(reads)
        assert patterns[name] == want_patterns
        assert summary.get(name, {}) == want_summary


def test_simple_pileup(spark, make_sam):
    sam = make_sam(
        [
            {"pos": 10, "cigar": "3M2D2M", "seq": "AAAAA", "tags": ["XM:Z:z.Zhx"]},
            {"pos": 12, "cigar": "2M1I1M", "seq": "AAAA", "tags": ["XM:Z:Z..z"]},
            {"pos": 30, "seq": "AAAA", "tags": ["XM:Z:...."]},
            {"pos": 5, "cigar": "6M", "seq": "A" * 6, "tags": ["XM:Z:......"]},
        ]
    )
    bed = spark.createDataFrame([("chr1", 11, 20, "r")], "chrom string, start long, end long, name string")
    rows = [(r["pos"], r["line"]) for r in pileup.render_pileup(pileup.order_pileup(pileup.region_reads(sam, bed))).collect()]
    # The read ending at 10 touches the region, as its end position counts as inside.
    assert rows == [(5, "......"), (10, "     z.Z--hx"), (12, "       Z..z")]
    genome = spark.createDataFrame([("chr1", 0, 0, "acgtacgtacgtacgtacgt")], "chrom string, chunk_no long, offset long, seq string")
    aligned = pileup.region_alignment(sam, bed, genome, "xm", 64)
    text = {r["qname"]: " " * r["pad"] + r["text"] for r in aligned.collect()}
    assert text["genome"] == "ACGTACGTA-CGT"
    assert text["r0"] == "     z.Z---.."
    assert text["r1"] == "       Z..z"


def test_read_ends_are_worked_out_once_before_the_join(spark, make_sam, monkeypatch):
    plans, cut = [], intervals.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(intervals, "cut_lineage", seen)
    text = F.md5(F.col("qname").cast("binary"))
    cigars = ["32M", "4M2I3M1I22M", "10M3D10M2D12M", "1M1D15M16I", "*"]
    sam = make_sam([{"pos": 100, "cigar": c, "tags": ["XM:Z:z"]} for c in cigars]).withColumn("seq", text)
    bed = spark.createDataFrame([("chr1", 90, 110, "r")], "chrom string, start long, end long, name string")
    rows = pileup.overlapping_reads(sam, bed).orderBy("line_no").collect()
    assert [r["loc3"] for r in rows] == [132, 129, 137, 117, 132]
    assert plans[0].count("md5(") == 1


def test_an_interval_of_the_longest_width_is_not_set_aside(spark):
    left = spark.createDataFrame([("c", 1, 2**62 + 5), ("c", 5, 9), ("c", 9, 5)], "chrom string, start long, end long")
    right = spark.createDataFrame([("c", 0, 2**63 - 1)], "chrom string, s long, e long")
    met = intervals.overlap_join(left, right, ("start", "end"), ("s", "e")).collect()
    assert sorted(r["start"] for r in met) == [1, 5]


def test_site_summary_gathers_no_sites_of_a_span(spark, make_sam):
    sam = make_sam([{"pos": p, "cigar": "4M", "seq": "AAAA", "tags": [f"XM:Z:{x}"]} for p, x in ((10, "zZ.z"), (11, "z..Z"), (11, "Z..."))])
    bed = spark.createDataFrame([("chr1", 10, 20, "r")], "chrom string, start long, end long, name string")
    summary = pileup.region_cpg_summary(sam, bed)
    assert "collect_list" not in summary._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["site"], r["meth"], r["unmeth"]) for r in summary.collect()}
    patterns, wanted = matrix_model(
        [{"line_no": i, "pos": p, "cigar": "4M", "loc3": p + 4, "xm": x} for i, (p, x) in enumerate(((10, "zZ.z"), (11, "z..Z"), (11, "Z...")))]
    )
    assert found == {(site, *counts) for site, counts in wanted.items()}
