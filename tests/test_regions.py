import math
import random
from bisect import bisect_right
from itertools import accumulate, pairwise

import pytest

from epilane.operators import intervals, regions
from epilane.operators.ordered import running
from pyspark.sql import Window
from pyspark.sql import functions as F


def sites_df(spark, chroms):
    return spark.createDataFrame(
        [(c, p) for c, positions in chroms.items() for p in positions], "chrom string, pos long"
    )


def starts(df):
    out = {}
    for r in df.orderBy("chrom", "pos").collect():
        out.setdefault((r["chrom"], r["region_start"]), []).append(r["pos"])
    return out


def test_running_crosses_tiles(spark):
    rng = random.Random(1)
    rows = [("a", p, rng.randint(0, 9)) for p in rng.sample(range(500), 90)]
    df = spark.createDataFrame(rows, "g string, pos long, v long")
    got = running(
        df,
        ["g"],
        ["pos"],
        {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))},
        F.floor(F.col("pos") / 20),
    )
    total, top = 0, 0
    for r in got.orderBy("pos").collect():
        total, top = total + r["v"], max(top, r["v"])
        assert (r["s"], r["m"]) == (total, top)
    before = running(df, ["g"], ["pos"], {"s": ("sum", F.col("v"))}, F.floor(F.col("pos") / 20), inclusive=False)
    total = 0
    for r in before.orderBy("pos").collect():
        assert r["s"] == total
        total += r["v"]


@pytest.mark.parametrize("tile", [1, 7, 64, 1 << 18])
def test_clusters_cross_tiles(spark, tile):
    rng = random.Random(tile)
    chroms = {c: sorted(rng.sample(range(1, 900), 120)) for c in "ab"}
    expected = {}
    for c, positions in chroms.items():
        last = None
        for p in positions:
            if last is None or p - last > 9:
                start = p
            expected.setdefault((c, start), []).append(p)
            last = p
    assert starts(regions.cluster_sites(sites_df(spark, chroms), 9, tile)) == expected


def split_model(reg, max_len, min_cpg):
    """Cut indexes by bisection; a bound from the back keeps every piece large enough."""
    n = len(reg)
    if n < min_cpg:
        return []
    k = min(math.ceil((reg[-1] - reg[0]) / max_len), n // min_cpg) if reg[-1] - reg[0] > max_len else 1
    targets = accumulate([reg[0] + 0.0] + [(reg[-1] - reg[0]) / k] * (k - 1))
    cuts = [0]
    for i, target in enumerate(targets):
        if i:
            cuts.append(max(bisect_right(reg, target), cuts[-1] + min_cpg))
    cuts = [min(c, n - (k - i) * min_cpg) for i, c in enumerate(cuts)]
    cuts[0] = 0
    return [reg[x:y] for x, y in pairwise([*cuts, n])]


def integer_model(reg, max_len):
    if not reg:
        return []
    if reg[-1] - reg[0] <= max_len:
        return [reg]
    pieces = math.ceil((reg[-1] - reg[0]) / max_len)
    step = (reg[-1] - reg[0]) // pieces
    out = []
    for i in range(pieces):
        low = reg[0] + i * step
        high = reg[0] + (i + 1) * step if i < pieces - 1 else reg[-1]
        out.append([p for p in reg if (p > low or i == 0) and p <= high])
    return [q for piece in out for q in integer_model(piece, max_len)]


@pytest.mark.parametrize(
    "reg,x,c,expected",
    [
        ([100, 200, 300, 400, 500, 600, 1000], 500, 3, [(100, 400), (500, 1000)]),
        ([1, 90, 180, 270, 360, 450, 540, 630], 500, 3, [(1, 270), (360, 630)]),
        ([1, 100, 200, 300, 400, 700], 300, 3, [(1, 200), (300, 700)]),
    ],
)
def test_worked_splits(spark, reg, x, c, expected):
    df = sites_df(spark, {"a": reg}).withColumn("region_start", F.lit(reg[0]).cast("long"))
    got = starts(regions.split_regions(df, x, c))
    assert sorted((p[0], p[-1]) for p in got.values()) == expected
    assert [(p[0], p[-1]) for p in split_model(reg, x, c)] == expected


@pytest.mark.parametrize("version,tile", [("float", 50), ("float", 1 << 18), ("integer", 50)])
def test_random_splits_match_the_sequential_rule(spark, version, tile):
    rng = random.Random(11)
    chroms = {}
    for i in range(60):
        span = rng.choice([90, 300, 1500])
        chroms[f"c{i}"] = sorted(rng.sample(range(1, span + 60), rng.randint(1, 50)))
    for x, c in ((37, 3), (100, 2)):
        df = sites_df(spark, chroms).withColumn("region_start", F.min("pos").over(Window.partitionBy("chrom")))
        expected = {}
        for name, reg in chroms.items():
            if version == "float":
                pieces = split_model(reg, x, c)
            else:
                pieces = integer_model(reg, x) if len(reg) >= c else []
            expected.update({(name, p[0]): p for p in pieces})
        assert starts(regions.split_regions(df, x, c, version, tile)) == expected


def counts_df(spark, rows):
    return spark.createDataFrame(rows, "sample string, chrom string, pos long, meth long, unmeth long")


def test_region_sums_use_every_sample_at_a_site(spark):
    rows = [
        ("a", "c", 10, 5, 5),
        ("b", "c", 10, 1, 1),
        ("a", "c", 20, 3, 0),
        ("b", "c", 20, 2, 0),
        ("b", "c", 30, 2, 0),
    ]
    got = regions.combine_regions(counts_df(spark, rows), 3, 1, 100, 2, 500, 4)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("c", 10, 20, 2, "a", 13, 8),
        ("c", 10, 20, 2, "b", 4, 3),
    ]
    got = regions.combine_regions(counts_df(spark, rows), 3, 1, 100, 2, 500, 5)
    assert [r["sample"] for r in got.collect()] == ["a"]
    wide = regions.regions_wide(got, ["a", "b"], fraction=True).first()
    assert (wide["a"], wide["b"]) == (8 / 13, None)


def test_repeated_position_in_a_sample_fails(spark):
    df = counts_df(spark, [("a", "c", 10, 5, 5)])
    assert regions.union_samples([df]).count() == 1
    with pytest.raises(Exception, match="repeated within a sample"):
        regions.union_samples([df, df]).collect()


def test_bed_regions_are_widened(spark):
    rows = [("a", "c", p, 1, 1) for p in (9, 10, 15, 21, 22)] + [("b", "c", 15, 0, 0)]
    bed = spark.createDataFrame([("c", 10, 20), ("d", 0, 5), ("c", 90, 95)], "chrom string, start long, end long")
    genome = spark.createDataFrame(
        [("c", i, i * 8, t) for i, t in enumerate(["ACGTACGT", "CCCCCCCC", "GGGCGTTT", "ACG"])],
        "chrom string, chunk_no long, offset long, seq string",
    )
    got = {(r["chrom"], r["start"]): r for r in regions.combine_bed(counts_df(spark, rows), bed, genome, 8).collect()}
    first = got[("c", 9)]
    # Positions 10 to 21 count; the boundary between chunks hides one CG.
    assert (first["end"], first["sample"], first["frac"], first["cpg"]) == (21, "a", 0.5, 2)
    assert got[("d", -1)]["cpg"] is None and got[("d", -1)]["sample"] is None
    assert got[("c", 89)]["cpg"] == 0


def test_interval_joins_match_brute_force(spark):
    rng = random.Random(3)
    pts = [("c", rng.randint(0, 300)) for _ in range(80)]
    ivs = [("c", s, s + rng.randint(0, 70), f"i{k}") for k, s in enumerate(rng.sample(range(300), 30))]
    points = spark.createDataFrame(pts, "chrom string, pos long")
    bed = spark.createDataFrame(ivs, "chrom string, start long, end long, name string")
    for closed in (False, True):
        got = sorted(
            (r["name"], r["pos"]) for r in intervals.interval_join(points, bed, closed=closed, bin_size=16).collect()
        )
        assert got == sorted(
            (n, p) for _, s, e, n in ivs for _, p in pts if s <= p < e + (1 if closed else 0)
        )
    left = intervals.interval_join(points, bed, how="left", bin_size=16)
    assert left.select("name").distinct().count() == 30
    reads = points.withColumn("to", F.col("pos") + 25)
    got = sorted(
        (r["name"], r["pos"])
        for r in intervals.overlap_join(reads, bed, ("pos", "to"), ("start", "end"), bin_size=16).collect()
    )
    assert got == sorted((n, p) for _, s, e, n in ivs for _, p in pts if p <= e and p + 25 >= s)
