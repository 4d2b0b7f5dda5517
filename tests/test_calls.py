import random
import re

import pytest
from pyspark.sql import functions as F

from epilane.operators import calls, linked


def model_calls(pos, cigar, xm, rc):
    """Walk the expanded alignment one base at a time."""
    chars = "".join(op * int(n) for n, op in re.findall(r"(\d+)([MID])", cigar))
    places = [k for k, c in enumerate(chars) if c != "D"]
    out = []
    for i, k in enumerate(places):
        if xm[i] not in "zZ":
            continue
        loc = pos + i - rc + chars[:k].count("D") - chars[1 : k + 1].count("I")
        if rc and k and chars[k - 1] == "D":
            stretch = re.search(r"[^M]*$", chars[:k]).group()
            loc -= len(stretch)
        ins = (k > 0 and chars[k - 1] == "I") if rc else chars[k] == "I"
        out.append((loc, xm[i], ins))
    return out


def tags(xm, rc):
    return [f"XM:Z:{xm}", f"XG:Z:{'GA' if rc else 'CT'}"]


@pytest.mark.parametrize(
    "cigar,rc,expected",
    [
        ("8M", 0, {0: 100, 7: 107}),
        ("8M", 1, {0: 99, 7: 106}),
        ("4M2D4M", 0, {3: 103, 4: 106, 7: 109}),
        ("4M2D4M", 1, {3: 102, 4: 103, 5: 106, 7: 108}),
        ("4M2I4M", 0, {3: 103, 4: "103*", 5: "103*", 6: 104, 9: 107}),
        ("4M2I4M", 1, {3: 102, 4: 102, 5: "102*", 6: "103*", 7: 104}),
        ("2I6M", 0, {0: "100*", 1: "100*", 2: 101, 7: 106}),
        ("2I6M", 1, {0: 99, 1: "99*", 2: "100*", 3: 101}),
    ],
)
def test_worked_locations(make_sam, cigar, rc, expected):
    length = sum(int(n) for n, op in re.findall(r"(\d+)([MI])", cigar))
    sam = make_sam([{"cigar": cigar, "seq": "A" * length, "tags": tags("z" * length, rc)}])
    rows = calls.read_calls(sam).first()["calls"]
    got = [f"{c['loc']}*" if c["ins"] else c["loc"] for c in rows]
    for index, value in expected.items():
        assert got[index] == value, (index, got)


def test_random_reads_match_the_walk(make_sam):
    rng = random.Random(7)
    records, expected = [], {}
    for n in range(400):
        ops = [f"{rng.randint(1, 5)}{rng.choice('MI')}"]
        for _ in range(rng.randint(0, 5)):
            ops.append(f"{rng.randint(1, 4)}{rng.choice('MMID')}")
        if ops[-1].endswith("D"):
            ops.append("3M")
        cigar, rc, pos = "".join(ops), rng.randint(0, 1), rng.randint(50, 90)
        length = sum(int(k) for k, _ in re.findall(r"(\d+)([MI])", cigar))
        xm = "".join(rng.choice("zZhx..") for _ in range(length))
        records.append({"cigar": cigar, "pos": pos, "seq": "A" * length, "tags": tags(xm, rc)})
        expected[f"r{n}"] = model_calls(pos, cigar, xm, rc)
    got = {
        r["qname"]: [(c["loc"], c["call"], c["ins"]) for c in r["calls"]]
        for r in calls.read_calls(make_sam(records)).collect()
    }
    assert got == expected


def test_unplaceable_alignments(make_sam):
    sam = make_sam([{"cigar": "2D8M", "tags": tags("z" * 8, 0)}, {"cigar": "4M3N6M", "tags": tags("z" * 10, 0)}])
    with pytest.raises(Exception, match="cannot place calls"):
        calls.cpg_calls(sam).collect()
    assert calls.cpg_calls(sam, mode="permissive").count() == 0


def pair(pos1, pos2, xm1, xm2, **more):
    one = {"qname": "p", "flag": 99, "pos": pos1, "rnext": "=", "pnext": pos2, "tags": tags(xm1, 0)}
    two = {"qname": "p", "flag": 147, "pos": pos2, "rnext": "=", "pnext": pos1, "tags": tags(xm2, 0)}
    return [{**one, **more}, {**two, **more}]


def sites(df):
    return sorted((r["line_no"], r["loc"], r["call"]) for r in df.collect())


def test_mates_do_not_count_a_site_twice(make_sam):
    sam = make_sam(pair(100, 105, "z....Z....", "Z....z...."))
    assert sites(calls.cpg_calls(sam)) == [(0, 100, "z"), (0, 105, "Z"), (1, 110, "z")]


def test_third_record_is_compared_with_the_first_only(make_sam):
    records = pair(100, 105, "z.........", "z....z....")
    records.append({**records[1], "pos": 110, "tags": tags("z.........", 0)})
    assert sites(calls.cpg_calls(make_sam(records))) == [
        (0, 100, "z"),
        (1, 105, "z"),
        (1, 110, "z"),
        (2, 110, "z"),
    ]


def test_mates_on_other_chromosomes_and_old_rules(make_sam):
    records = pair(100, 100, "z.........", "z.........")
    records[0].update(rnext="chr2")
    records[1].update(rname="chr2", rnext="chr1")
    assert len(sites(calls.cpg_calls(make_sam(records)))) == 2
    assert len(sites(calls.cpg_calls(make_sam(records), version="old"))) == 2
    extra = {"flag": 256, "tags": tags("Z.........", 0)}
    assert len(sites(calls.cpg_calls(make_sam([extra])))) == 0
    assert len(sites(calls.cpg_calls(make_sam([extra]), version="old"))) == 1


def test_inserted_sites_count_in_totals_only(make_sam):
    sam = make_sam([{"cigar": "4M2I4M", "tags": tags("....Z....z", 0)}, {"flag": 4, "tags": []}])
    counts = calls.cpg_counts(calls.cpg_calls(sam)).collect()
    assert [(r["pos"], r["meth"], r["unmeth"], r["pct"]) for r in counts] == [(107, 0, 1, 0.0)]
    total = calls.cpg_summary(sam).first()
    assert (total["reads"], total["mapped"], total["calls"], total["methylated"], total["pct"]) == (2, 1, 2, 1, 50.0)


def test_linked_pattern(spark):
    # Region and patterns of a documented example of the report.
    at = [102, 109, 123, 140, 147, 168]
    reads = {"read1": "00100-", "read2": "001100", "read3": "--0000"}
    rows = [
        (i, name, "chrZ", pos, "Z" if mark == "1" else "z", False)
        for i, (name, marks) in enumerate(reads.items())
        for pos, mark in zip(at, marks)
        if mark != "-"
    ]
    df = spark.createDataFrame(rows, "line_no long, qname string, chrom string, loc long, call string, ins boolean")
    bed = spark.createDataFrame(
        [("chrZ", 100, 200, "a"), ("chrZ", 300, 400, "b")], "chrom string, start long, end long, name string"
    )
    got = {(r["name"], r["qname"]): (r["sites"], r["pattern"]) for r in linked.linked_methylation(df, bed).collect()}
    assert got == {**{("a", k): (6, v) for k, v in reads.items()}, ("b", None): (0, "<none>")}
    twice = df.unionByName(df)
    with pytest.raises(Exception, match="both states"):
        linked.linked_methylation(twice, bed).collect()


def test_call_indexes_of_batches(spark):
    """Calls found by batches are those found piece by piece; few texts go that way."""
    texts = [None, "", "z", "..Zhz", "hHxX....", "\u00e9z.Z", "zZ" * 300, "...", "Z.", ":z;"]
    df = spark.createDataFrame([(t,) for t in texts], "xm string").repartition(3)
    found = df.select(
        calls._call_indexes(F.col("xm")).alias("a"), calls._call_indexes_by_piece(F.col("xm")).alias("b")
    )
    assert all(r["a"] == r["b"] for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
