"""A third of all rows in one key: results stay whole, and joins may split the key."""

import random

from pyspark.sql import functions as F

from epilane.operators import calls, intervals, reads


def tagged(rng):
    xm = "".join(rng.choice("zZ....") for _ in range(10))
    return xm, [f"XM:Z:{xm}", "XG:Z:CT"]


def test_one_name_with_a_third_of_the_reads(make_sam):
    rng = random.Random(9)
    records, texts = [], []
    for i in range(300):
        xm, tags = tagged(rng)
        hot = i % 3 == 0
        texts.append(xm)
        records.append(
            {"qname": "hot" if hot else f"r{i // 2}", "flag": 97, "rnext": "=", "pos": rng.randint(1, 30), "tags": tags}
        )
    first, expected = {}, {}
    for r, xm in zip(records, texts):
        own = {r["pos"] + k: c for k, c in enumerate(xm) if c in "zZ"}
        blocked = first.setdefault(r["qname"], {}) if r["qname"] in first else {}
        first.setdefault(r["qname"], own)
        for loc, c in own.items():
            if loc not in blocked:
                expected.setdefault(loc, [0, 0])[c == "z"] += 1
    got = calls.cpg_counts(calls.cpg_calls(make_sam(records))).collect()
    assert {r["pos"]: [r["meth"], r["unmeth"]] for r in got} == expected
    fastq = reads.sam_to_fastq(make_sam(records))
    assert fastq.count() == len({r["qname"] for r in records})


def test_one_position_with_a_third_of_the_copies(make_sam):
    rng = random.Random(10)
    records = [
        {"pos": 7 if i % 3 == 0 else rng.randint(1, 90), "seq": rng.choice(["ACGTACGTAC", "TTTTTTTTTT"])}
        for i in range(300)
    ]
    places = {}
    for i, r in enumerate(records):
        places.setdefault((r["pos"], r["seq"]), []).append(i)
    kept = {r["line_no"] for r in reads.dedup_reads(make_sam(records), "seq").collect()}
    assert kept == {lines[0] for lines in places.values()}
    best = {}
    for (pos, _), lines in places.items():
        best[pos] = min(best.get(pos, (0, 0)), (-len(lines), lines[0]))
    kept = {r["line_no"] for r in reads.dedup_reads(make_sam(records), "consensus").collect()}
    assert kept == {line for _, line in best.values()}


def test_hot_bin_is_split_by_the_join(spark):
    """With broadcasts off and small targets, the hot bin's join partition is split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        points = spark.range(0, 60000, 1, 8).select(
            F.lit("c").alias("chrom"),
            F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") * 50).cast("long").alias("pos"),
            F.col("id"),
        )
        bed = spark.range(0, 3000000, 5000).select(
            F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 1000).alias("end"), F.col("id").alias("name")
        )
        joined = intervals.interval_join(points, bed)
        assert joined.count() == points.filter(F.col("pos") % 5000 < 1000).count()
        rows = joined.select("id", "name")
        rows.write.format("noop").mode("overwrite").save()
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_quartiles_of_a_million_regions_in_two_groups(spark):
    import numpy as np

    from epilane.operators.ordered import exact_quantiles

    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=700_000), "b": np.round(rng.exponential(3, 300_000), 1)}
    values["b"][:100_000] = 2.0  # a third of a group is one value
    frame = spark.createDataFrame(
        [{"g": g, "v": v.tolist()} for g, v in values.items()], "g string, v array<double>"
    ).select("g", F.explode("v").alias("v"))
    frame = frame.unionByName(
        spark.createDataFrame([("a", None), ("a", float("nan")), (None, 1.0)], "g string, v double")
    )
    spread = frame.repartition(8)
    got = exact_quantiles(spread, "g", "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    for g, v in values.items():
        assert np.allclose(got[g], np.quantile(v, [0, 0.25, 0.5, 0.75, 1]), rtol=0, atol=1e-12)
    tied = spark.createDataFrame([("c", 1.5)] * 5 + [("d", -7.0), ("d", 9.0)], "g string, v double")
    assert exact_quantiles(tied, "g", "v", [0.25, 0.5]) == {"c": [1.5, 1.5], "d": [-3.0, 1.0]}
    assert exact_quantiles(tied.filter("false"), "g", "v", [0.5]) == {}


def test_intervals_as_long_as_a_chromosome(spark):
    rng = random.Random(12)
    sizes = [1, 30, 4096, 4097, 70_000, 3_000_000, 250_000_000]
    bed, points = [], []
    for i in range(120):
        start = rng.randrange(0, 250_000_000)
        bed.append(("c", start, min(start + rng.choice(sizes), 250_000_000), i))
    bed += [("c", 0, 250_000_000, 1000), ("d", 5, 5, 1001)]
    points = [("c", rng.choice(bed)[1] + rng.randrange(-3, 5000), i) for i in range(400)]
    frame = spark.createDataFrame(bed, "chrom string, start long, end long, name int")
    spots = spark.createDataFrame(points, "chrom string, pos long, k int")
    low, last = F.col("start"), F.col("end") - 1
    rows = intervals.interval_bins(
        frame.filter("end > start"), low, last, intervals.bin_level(low, last)
    )
    assert rows.groupBy("name").count().agg(F.max("count")).first()[0] <= 2
    got = {(r["name"], r["k"]) for r in intervals.interval_join(spots, frame).collect()}
    assert got == {(n, k) for c, s, e, n in bed for d, p, k in points if c == d and s <= p < e}
    other = [("c", s + rng.randrange(-9000, 9000), 0, i) for i, (_, s, _, _) in enumerate(bed)]
    other = [(c, s, s + rng.choice(sizes), i) for c, s, _, i in other]
    right = spark.createDataFrame(other, "chrom string, s long, e long, id int")
    met = [(r["name"], r["id"]) for r in intervals.overlap_join(frame, right, ("start", "end"), ("s", "e")).collect()]
    assert sorted(met) == sorted((n, i) for c, s, e, n in bed for d, x, y, i in other if c == d and s <= y and e >= x)


def test_the_larger_side_of_an_overlap_join_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    # Intervals of all widths: those wider than any of the other side are joined too.
    rows = [("a" if i % 3 else "b", i * 37 - 500, i * 37 - 500 + 9**(i % 6), i) for i in range(60)]
    left = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(counted), "chrom string, start long, end long, id int")
    other = [("a", 0, 40, 1), ("b", 900, 905, 2), ("a", 1200, 1330, 3), ("c", 0, 9, 4)]
    right = spark.createDataFrame(other, "chrom string, s long, e long, k int")
    got = intervals.overlap_join(left, right, ("start", "end"), ("s", "e"), bin_size=16).collect()
    want = [(i, k) for c, s, e, i in rows for d, x, y, k in other if c == d and s <= y and e >= x]
    assert sorted((r["id"], r["k"]) for r in got) == sorted(want)
    assert seen.value == len(rows)


def test_reads_of_a_place_are_dealt_once_and_then_counted(spark, make_sam):
    from collections import Counter

    records = [{"pos": 10 + i % 7, "rname": f"chr{i % 2}", "seq": "ACGT" * (1 + i * i % 5)} for i in range(300)]
    sam = make_sam(records)
    counts = Counter((r["rname"], r["pos"], r["seq"]) for r in records)
    places = {k[:2] for k in counts}
    best = {p: max((n, -min(i for i, r in enumerate(records) if (r["rname"], r["pos"], r["seq"]) == k)) for k, n in counts.items() if k[:2] == p) for p in places}
    top, kept, summary = reads.top_sequence(sam), reads.dedup_reads(sam, "consensus"), reads.dedup_summary(sam)
    assert top.columns == ["rname", "loc", "reverse", "seq", "copies"]
    assert {(r["rname"], r["loc"]): r["copies"] for r in top.collect()} == {p: b[0] for p, b in best.items()}
    assert sorted(r["line_no"] for r in kept.collect()) == sorted(-b[1] for b in best.values())
    assert tuple(summary.first()) == (300, len(places), len(counts) - len(places), 300 - len(counts))
    for df in (top, kept, summary):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning" in line]
        # One exchange, of the rows as they come, into more parts than the session's default.
        assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0] and "partial" not in plan.split("Exchange hashpartitioning")[-1]
