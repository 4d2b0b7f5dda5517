"""What a query leaves on disk while it goes on."""

import glob
import gzip

from pyspark.sql import functions as F

from epilane.session import DROP_SHUFFLES, Scratch, cut_lineage
from epilane.sources import sinks


def shuffles_held(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def lineitem(spark, folder, rows):
    """Rows ``(order, line, part)`` as the table that alignments are made of."""
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").selectExpr(
        "*", "l_partkey as l_suppkey", "1.0 as l_quantity", "1.0 as l_extendedprice", "0.1 as l_discount", "0.1 as l_tax"
    ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_stored_steps_keep_no_shuffle_files(spark, make_sam, tmp_path):
    def counted():
        return spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()

    before, set_ = shuffles_held(spark), spark.conf.get(DROP_SHUFFLES, None)
    cut = cut_lineage(counted())
    sinks.write_sam(make_sam([{"pos": 9 - i} for i in range(9)]), None, str(tmp_path / "sam"))
    with Scratch(spark) as scratch:
        stored = scratch.table(counted(), "t")
        assert stored.count() == cut.count() == 7
        scratch.drop("t")
        assert not glob.glob(scratch.path.removeprefix("file://") + "/t")
    # The two counts above ran outside, and may hold one each.
    assert shuffles_held(spark) <= before + 2
    assert spark.conf.get(DROP_SHUFFLES, None) == set_
    ran = counted()
    assert ran.collect() and cut_lineage(ran).count() == 7 and len(ran.collect()) == 7


def test_sam_roundtrip_writes_packed_text(spark, tmp_path, monkeypatch):
    from epilane.plans import catalog

    kinds = []

    def written(df, header, path, write=sinks.write_sam):
        write(df, header, path)
        for name in glob.glob(path.removeprefix("file://") + "/part-*"):
            with gzip.open(name) as f:
                kinds.append(len(f.read().splitlines()))

    monkeypatch.setattr(sinks, "write_sam", written)
    folder = lineitem(spark, tmp_path, [(k // 3, k % 3 + 1, k) for k in range(60)])
    back = catalog.sam_roundtrip(spark, folder)
    assert sum(kinds) == back.count() == 60
    from epilane.plans import tables

    assert {r["seq"] for r in back.collect()} == {r["seq"] for r in tables.alignments(spark, folder).collect()}


def test_rounds_of_the_duplicate_search_are_dropped(spark, tmp_path):
    """A chain of reads, each sharing a key with the next, takes a round for every other one."""
    from epilane.operators.duplicates import _greedy

    rows = [(f"r{i}", (-100 + i, f"r{i}"), k, f"k{i + k}") for i in range(7) for k in range(2)]
    rows += [("s0", (-9, "s0"), 0, "lone"), ("s1", (-8, "s1"), 0, "lone")]
    edges = spark.createDataFrame(rows, "qname string, rank struct<score:long,qname:string>, ord long, key string")
    with Scratch(spark) as scratch:
        found, _ = _greedy(scratch.table(edges, "edges"), None, "x", scratch)
        got = {r["qname"]: (r["aln"], r["parent"]) for r in scratch.result(found).collect()}
        left = {name.rsplit("/", 1)[-1] for name in glob.glob(scratch.path.removeprefix("file://") + "/*")}
    assert got == {f"r{i}": (f"aln:k{i}", f"r{i - 1}") for i in (1, 3, 5)} | {"s1": ("aln:lone", "s0")}
    assert left == {"edges", "x-alone", *(f"x-kept{i}" for i in range(4))}


def test_ranked_duplicates_leave_no_tables(spark, make_sam):
    from epilane.operators.duplicates import find_dups
    from epilane.session import shared_folder

    found = find_dups(make_sam([{"qname": "a", "pos": 5}, {"qname": "b", "pos": 5, "qual": "5" * 10}]))
    assert not glob.glob(shared_folder(spark).removeprefix("file://") + "/epilane-*")
    assert [(r["qname"], r["parent"]) for r in found.collect()] == [("b", "a")]


def test_fastq_of_mates_is_packed_and_reads_stored_steps(spark, make_sam, tmp_path, monkeypatch):
    from epilane.operators import reads
    from epilane.plans import catalog

    ends = reads.sam_to_fastq_pe(make_sam([{"qname": "a", "flag": 99, "pos": 5, "pnext": 9}, {"qname": "a", "flag": 147, "pos": 9, "pnext": 5}]))
    assert "Window" not in ends._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["name"] for r in ends.collect()) == ["a /1", "a /2"]
    lines = []

    def written(df, path, write=sinks.write_fastq):
        # What is written was stored: the reads are not paired again for sampling and sorting.
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        write(df, path)
        for name in glob.glob(path.removeprefix("file://") + "/end=[12]/part-*"):
            with gzip.open(name) as f:
                lines.append(len(f.read().splitlines()))

    monkeypatch.setattr(sinks, "write_fastq", written)
    back = catalog.fastq_pe_roundtrip(spark, lineitem(spark, tmp_path, [(k // 3, k % 3 + 1, k) for k in range(60)]))
    rows = back.collect()
    # Orders not divisible by three have a pair.
    assert len(rows) == 13 and sum(lines) == 13 * 2 * 4
    assert all(r["name_1"].removesuffix(" /1") == r["name_2"].removesuffix(" /2") for r in rows)
