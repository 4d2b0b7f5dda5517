"""Paired records as a stream: counts equal the batch operators', state empties."""

import time

import pytest
from pyspark.sql import functions as F

from epilane.operators import calls
from epilane.plans import tables
from epilane.sources import alignments, sinks
from epilane.streaming import counts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(counts.STATE_STORE, None)
    spark.conf.set(counts.STATE_STORE, counts.ROCKS)
    yield
    if before is None:
        spark.conf.unset(counts.STATE_STORE)
    else:
        spark.conf.set(counts.STATE_STORE, before)


def run(spark, tmp_path, folder, **options):
    records = counts.stream_sam(spark, str(folder), ordered=True, files=1)
    out = str(tmp_path / "settled")
    query = (
        counts.stream_mate_calls(records, **options)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    state = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    return spark.read.schema(counts.SETTLED).parquet(out), state


def test_pairs_over_several_files_equal_the_batch(spark, tmp_path, rocks):
    sam = tables.alignments(spark, FOLDER).filter("flag < 256").orderBy("line_no").limit(900)
    sam = sam.withColumn("pos", F.when(F.col("flag") == 147, F.col("pos") - 25).otherwise(F.col("pos")))  # mates overlap
    folder = tmp_path / "sam"
    folder.mkdir()
    rows = [r["value"] for r in sinks.sam_lines(sam).orderBy("line_no").collect()]
    cut = len(rows) // 3 + 1  # mates fall on both sides of the cuts
    for k in range(3):
        (folder / f"{k}.sam").write_text("\n".join(rows[k * cut : (k + 1) * cut]) + "\n")
    settled, _ = run(spark, tmp_path, folder)
    whole = tmp_path / "whole.sam"
    whole.write_text("\n".join(rows) + "\n")
    batch = calls.cpg_calls(alignments.read_sam(spark, str(whole)))
    columns = ["chrom", "pos", "meth", "unmeth", "pct"]
    expected = calls.cpg_counts(batch).select(*columns).collect()
    assert sorted(map(tuple, counts.settled_counts(settled).select(*columns).collect())) == sorted(map(tuple, expected))
    assert settled.count() == batch.count() < calls.unfold_calls(calls.place_calls(sam), "chrom").count()


def line(name, flag, pos, xm):
    return f"{name}\t{flag}\tchr1\t{pos}\t9\t{len(xm)}M\t=\t1\t0\t{'A' * len(xm)}\t{'I' * len(xm)}\tXM:Z:{xm}\tXG:Z:CT\n"


def test_state_empties_when_all_mates_have_come(spark, tmp_path, rocks):
    folder = tmp_path / "sam"
    folder.mkdir()
    alone = "".join(line(f"s{i}", 73, 5, "Z") for i in range(2))  # mates unmapped
    (folder / "0.sam").write_text(line("a", 99, 10, "Z.z.") + line("b", 99, 50, "z...") + alone)
    (folder / "1.sam").write_text(line("a", 147, 12, "zZ..") + line("b", 147, 50, "Z..Z"))
    settled, state = run(spark, tmp_path, folder)
    got = sorted((r["loc"], r["call"]) for r in settled.collect())
    assert got == sorted([(10, "Z"), (12, "z"), (13, "Z"), (50, "z"), (53, "Z"), (5, "Z"), (5, "Z")])
    assert max(state) == 2 and state[-1] == 0


def test_names_without_a_mate_are_forgotten(spark, tmp_path, rocks):
    folder = tmp_path / "sam"
    folder.mkdir()
    (folder / "0.sam").write_text(line("a", 99, 10, "Z.z."))
    records = counts.stream_sam(spark, str(folder), ordered=True)
    query = (
        counts.stream_mate_calls(records, wait_ms=1)
        .writeStream.format("memory")
        .queryName("forgotten")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(processingTime="1 second")
        .start()
    )
    try:
        until = time.time() + 60
        while time.time() < until:
            state = [x["numRowsTotal"] for p in query.recentProgress for x in p["stateOperators"]]
            if state and max(state) > 0 and state[-1] == 0:
                break
            time.sleep(1)
        assert max(state) > 0 and state[-1] == 0
        assert sorted(r["loc"] for r in spark.table("forgotten").collect()) == [10, 12]
    finally:
        query.stop()


def test_state_store_is_named(spark, tmp_path):
    records = counts.stream_sam(spark, str(tmp_path), ordered=True)
    with pytest.raises(ValueError, match="stateStore"):
        counts.stream_mate_calls(records)
