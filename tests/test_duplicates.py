import random

import pytest

from epilane.operators import duplicates
from epilane.operators.duplicates import _greedy, find_dups


def edges_df(spark, reads):
    """``reads``: name -> (score, keys)."""
    rows = [
        (name, (-score, name), i, key)
        for name, (score, keys) in reads.items()
        for i, key in enumerate(keys)
    ]
    return spark.createDataFrame(
        rows, "qname string, rank struct<score:long,qname:string>, ord long, key string"
    )


def greedy_model(reads, owned):
    owners, dups = dict(owned), {}
    for name in sorted(reads, key=lambda r: (-reads[r][0], r)):
        hit = next((k for k in reads[name][1] if k in owners), None)
        if hit is not None:
            dups[name] = (hit, owners[hit])
        else:
            owners.update({k: name for k in reads[name][1]})
    return dups


def solve(spark, reads, owned=None):
    taken = None
    if owned:
        taken = spark.createDataFrame(
            [(k, p, None) for k, p in owned.items()],
            "key string, parent string, owner_rank struct<score:long,qname:string>",
        )
    found, _ = _greedy(edges_df(spark, reads), taken, "x")
    return {r["qname"]: (r["aln"][4:], r["parent"]) for r in found.collect()}


def test_duplicate_owns_nothing(spark):
    reads = {"A": (90, ["k1", "k2"]), "B": (80, ["k2", "k3"]), "C": (70, ["k3"])}
    assert solve(spark, reads) == {"B": ("k2", "A")}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_match_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    reads = {
        f"r{i}": (rng.randint(0, 12), rng.sample([f"k{j}" for j in range(60)], rng.randint(1, 4)))
        for i in range(90)
    }
    owned = {f"k{j}": "pe" for j in range(5)} if seed % 2 else {}
    assert solve(spark, reads, owned) == greedy_model(reads, owned)


def test_one_key_shared_by_most_reads(spark):
    reads = {f"r{i:03d}": (i, ["hot", f"own{i}"]) for i in range(200)}
    got = solve(spark, reads)
    assert len(got) == 199 and set(got.values()) == {("hot", "r199")}


def slot_model(records, primary):
    """Slots in file order: fill a waiting partner, else copy the last filled one, else wait."""
    slots = []
    for seg, key, aln, mate in records:
        match = None
        for slot in slots:
            if slot["by"] != seg and slot["place"] == (mate, aln):
                if slot["sides"][seg] is None:
                    slot["sides"][seg] = key
                    break
                match = slot
        else:
            sides = [None, None]
            sides[seg] = key
            if match is not None:
                sides[1 - seg] = match["sides"][1 - seg]
            slots.append({"by": seg, "place": (aln, mate), "sides": sides})
    return sorted(
        tuple(s if s is not None else primary[i] for i, s in enumerate(slot["sides"])) for slot in slots
    )


def test_pairing_without_hit_index(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for n in range(120):
        name, records = f"r{n}", []
        for i in range(rng.randint(1, 9)):
            seg = rng.randint(0, 1)
            spots = (rng.choice(["x:1", "x:2"]), "y:5")
            aln, mate = spots if seg == 0 else spots[::-1]
            key = f"k{i}"
            records.append((seg, key, aln, mate))
            rows.append((name, i, seg, key, aln, mate))
        expected[name] = slot_model(records, ("P0", "P1"))
    secondary = spark.createDataFrame(
        rows, "qname string, line_no long, segment int, key string, place string, mate_place string"
    )
    primary = spark.createDataFrame([(n, "P0", "P1") for n in expected], "qname string, aln0 string, aln1 string")
    got = {}
    for r in duplicates.pair_by_coord(secondary, primary).collect():
        got.setdefault(r["qname"], []).append((r["aln0"], r["aln1"]))
    assert {k: sorted(v) for k, v in got.items()} == expected


def mates(name, pos1, pos2, qual="I" * 10, **more):
    return [
        {"qname": name, "flag": 99, "pos": pos1, "rnext": "=", "pnext": pos2, "qual": qual, **more},
        {"qname": name, "flag": 147, "pos": pos2, "rnext": "=", "pnext": pos1, "qual": qual, **more},
    ]


def report(df):
    return sorted((r["qname"], r["parent"], r["type"]) for r in df.collect())


def test_pairs_then_singles(make_sam):
    swapped = mates("b", 100, 200, "5" * 10)
    swapped[0]["flag"], swapped[1]["flag"] = 163, 83
    records = [
        *mates("a", 100, 200),
        *swapped,
        *mates("c", 100, 201),
        {"qname": "s1", "pos": 100, "qual": "I" * 10},
        {"qname": "s2", "pos": 300, "qual": "5" * 10},
        {"qname": "s3", "pos": 300, "qual": "I" * 10},
        {"qname": "s4", "flag": 16, "pos": 300},
        {"qname": "s5", "flag": 256, "pos": 300},
    ]
    sam = make_sam(records)
    assert report(find_dups(sam)) == [
        ("b", "a", "paired-end"),
        ("s1", "a", "single-end"),
        ("s2", "s3", "single-end"),
    ]
    aln = [r["aln"] for r in find_dups(sam).collect() if r["qname"] == "b"]
    assert aln == ["aln:(('chr1', 100, (), '+'), ('chr1', 210, (), '-'))"]
    alone = report(find_dups(sam, paired=False))
    assert ("b", "a", "single-end") in alone and ("c", "a", "single-end") in alone
    # The secondary record s5 has a read, but no primary, so it is judged in input order only.
    first_seen = report(find_dups(sam, rank="input"))
    assert first_seen == [
        ("b", "a", "paired-end"),
        ("s1", "a", "single-end"),
        ("s3", "s2", "single-end"),
        ("s5", "s2", "single-end"),
    ]


def test_clips_and_splices_enter_the_key(make_sam):
    records = [
        {"qname": "a", "cigar": "10M", "pos": 100},
        {"qname": "b", "cigar": "3S7M", "pos": 103, "qual": "5" * 10},
        {"qname": "c", "cigar": "5M50N5M", "pos": 100, "qual": "5" * 10},
        {"qname": "d", "cigar": "5M50N5M", "pos": 100, "qual": "4" * 10},
        {"qname": "e", "cigar": "5M50N4M1S", "pos": 100, "qual": "4" * 10, "flag": 16},
    ]
    assert report(find_dups(make_sam(records))) == [("b", "a", "single-end"), ("d", "c", "single-end")]
    paired = [r for r in records]
    for r in paired:
        r["flag"] = r.get("flag", 0) | 8
    assert report(find_dups(make_sam(paired), mode="tophat")) == [("d", "c", "single-end")]


def test_hit_index_pairs_and_bad_input(make_sam):
    hi = [*mates("a", 100, 200, tags=["HI:i:1"]), *mates("a", 500, 600, tags=["HI:i:2"])]
    hi[2]["flag"], hi[3]["flag"] = 355, 403
    other = mates("b", 500, 600, "5" * 10, tags=["HI:i:1"])
    assert report(find_dups(make_sam(hi + other))) == [("b", "a", "paired-end")]
    assert report(find_dups(make_sam(hi + other), mode="tophat")) == [("b", "a", "paired-end")]
    with pytest.raises(Exception, match="one side only of a pair"):
        find_dups(make_sam(hi + other[:1])).collect()
    assert report(find_dups(make_sam(hi + other[:1]), incomplete="drop")) == []
    with pytest.raises(Exception, match="several records on one side"):
        find_dups(make_sam(other + other[:1])).collect()


def test_picard_rules(make_sam):
    records = [
        *mates("a", 100, 200),
        *mates("b", 100, 200),
        {"qname": "s1", "flag": 73, "pos": 100},
        {"qname": "s2", "flag": 73, "pos": 400},
        {"qname": "s3", "flag": 73, "pos": 400, "cigar": "5M7N5M"},
        {"qname": "s4", "flag": 73 + 256, "pos": 400},
    ]
    assert report(find_dups(make_sam(records), mode="picard")) == [
        ("b", "a", "paired-end"),
        ("s1", "a", "SE->PE"),
        ("s3", "s2", "SE->PE"),
    ]


def test_score_of_pairs_and_single_reads(make_sam):
    records = [*mates("a", 1, 50, "!" * 9 + "I"), {"qname": "s", "qual": "I" * 10}, {"qname": "s", "qual": "5" * 10}]
    got = {(r["qname"], r["kind"]): r["score"] for r in duplicates.read_scores(make_sam(records)).collect()}
    assert got == {("a", "pair"): 80, ("s", "single"): 200}


def test_hit_pairs_make_keys_once(spark, tmp_path):
    """The keys of the hits are written before they are paired: the hits are scanned once."""
    from epilane.plans import flows

    spark.range(40).selectExpr(
        "id div 2 as l_orderkey", "cast(id % 2 + 1 as int) as l_linenumber", "id as l_partkey",
        "id as l_suppkey", "1.0 as l_quantity", "1.0 as l_extendedprice", "0.1 as l_discount", "0.1 as l_tax",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = flows.hit_pairs(spark, str(tmp_path))
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found.count() == 40


def coord_frames(spark, seed=6):
    rng = random.Random(seed)
    rows, expected = [], {}
    for n in range(60):
        name, records = f"r{n}", []
        for i in range(rng.randint(1, 9)):
            seg = rng.randint(0, 1)
            spots = (rng.choice(["x:1", "x:2"]), "y:5")
            aln, mate = spots if seg == 0 else spots[::-1]
            records.append((seg, f"k{i}", aln, mate))
            rows.append((name, i, seg, f"k{i}", aln, mate))
        expected[name] = slot_model(records, ("P0", "P1"))
    secondary = spark.createDataFrame(
        rows, "qname string, line_no long, segment int, key string, place string, mate_place string"
    )
    primary = spark.createDataFrame([(n, "P0", "P1") for n in expected], "qname string, aln0 string, aln1 string")
    return secondary, primary, expected


def test_pairing_by_coordinates_deals_records_once(spark, monkeypatch):
    secondary, primary, expected = coord_frames(spark)

    def found(df):
        got = {}
        for r in df.collect():
            got.setdefault(r["qname"], []).append((r["aln0"], r["aln1"]))
        return {k: sorted(v) for k, v in got.items()}

    pairs = duplicates.pair_by_coord(secondary, primary)
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # One exchange of the records, and one of the primary pairs unless these are broadcast.
    assert len(dealt) <= 2 and all("qname" in line and "c0" not in line for line in dealt)
    assert found(pairs) == expected
    for most in (5, 0):  # some reads, then all of them, are dealt over several tasks
        monkeypatch.setattr(duplicates, "CROWDED", most)
        assert found(duplicates.pair_by_coord(secondary, primary)) == expected
