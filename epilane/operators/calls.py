"""CpG methylation calls from aligned reads.

Locations come from the CIGAR in closed form: every M or I run carries what lies
before it, so each call is placed by one lookup. Mates that overlap are compared
while calls are still arrays on the read, before anything is unfolded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.functions import sam as s
from epilane.functions.cigar import cigar_ops
from epilane.session import cut_lineage

CALL_TYPE = "array<struct<loc:bigint,call:string,ins:boolean>>"


def _segments(cigar: Column) -> Column:
    """M and I runs with: first read index ``at``, deleted and inserted bases before
    them, the operation just before, and the length of the non-M stretch before."""
    zero = F.lit(0)
    empty = F.array().cast(
        "array<struct<op:string,at:int,len:int,d:int,i:int,prev:string,gap:int>>"
    )
    start = F.struct(
        zero.alias("at"),
        zero.alias("d"),
        zero.alias("i"),
        F.lit("").alias("prev"),
        zero.alias("gap"),
        empty.alias("runs"),
    )

    def step(acc, run):
        deleted, inserted = run["op"] == "D", run["op"] == "I"
        here = F.struct(
            run["op"].alias("op"),
            acc["at"].alias("at"),
            run["len"].alias("len"),
            acc["d"].alias("d"),
            acc["i"].alias("i"),
            acc["prev"].alias("prev"),
            acc["gap"].alias("gap"),
        )
        return F.struct(
            (acc["at"] + F.when(deleted, 0).otherwise(run["len"])).alias("at"),
            (acc["d"] + F.when(deleted, run["len"]).otherwise(0)).alias("d"),
            (acc["i"] + F.when(inserted, run["len"]).otherwise(0)).alias("i"),
            run["op"].alias("prev"),
            F.when(run["op"] == "M", 0).otherwise(acc["gap"] + run["len"]).alias("gap"),
            F.when(deleted, acc["runs"])
            .otherwise(F.concat(acc["runs"], F.array(here)))
            .alias("runs"),
        )

    runs = F.filter(cigar_ops(cigar), lambda r: r["len"] > 0)
    return F.aggregate(runs, start, step, lambda acc: acc["runs"])


def _call_places(texts: pa.Array) -> pa.Array:
    """Index and letter of every z/Z of each text, over the batch's one buffer of bytes."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    found = np.flatnonzero((data[ends[0] : ends[-1]] | 32) == ord("z")) + ends[0]
    bounds = np.searchsorted(found, ends)
    at = found - np.repeat(ends[:-1], np.diff(bounds))
    letters = pa.array(["z", "Z"]).take(pa.array(data[found] == ord("Z")).cast(pa.int8()))
    calls = pa.StructArray.from_arrays([pa.array(at, pa.int32()), letters], ["i", "call"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), calls, mask=texts.is_null())


def _call_indexes(xm: Column) -> Column:
    """``array<struct<i,call>>`` of the z/Z letters. Plain text is searched by batches."""

    @F.arrow_udf("array<struct<i:int,call:string>>")
    def places(texts: pa.Array) -> pa.Array:
        return _call_places(texts)

    return F.when(xm.rlike(r"[^\x00-\x7F]"), _call_indexes_by_piece(xm)).otherwise(places(xm))


def _call_indexes_by_piece(xm: Column) -> Column:
    """The same, from the pieces that end in a call."""
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<i:int,call:string>>").alias("found")
    )

    def step(acc, piece):
        here = F.struct(
            (acc["at"] + F.length(piece) - 1).alias("i"), F.right(piece, F.lit(1)).alias("call")
        )
        return F.struct(
            (acc["at"] + F.length(piece)).alias("at"),
            F.concat(acc["found"], F.array(here)).alias("found"),
        )

    return F.aggregate(
        F.regexp_extract_all(xm, F.lit("[^zZ]*[zZ]"), F.lit(0)), start, step, lambda a: a["found"]
    )


def call_array(pos: Column, runs: Column, idx: Column, reverse: Column) -> Column:
    """``array<struct<loc,call,ins>>`` of a read. ``reverse`` marks reads whose calls
    sit on the G of the reverse strand; their location is that of the C before it.
    ``idx`` holds the call indexes, ``runs`` the placed CIGAR runs (NULL for a single
    M run)."""
    rc = reverse.cast("int")
    simple = F.transform(
        idx,
        lambda c: F.struct(
            (pos + c["i"] - rc).cast("bigint").alias("loc"),
            c["call"].alias("call"),
            F.lit(False).alias("ins"),
        ),
    )
    # The run of each call is looked up once, then read by field.
    looked_up = F.transform(
        idx,
        lambda c: F.struct(
            c["i"].alias("i"),
            c["call"].alias("call"),
            F.get(
                F.filter(runs, lambda r: (r["at"] <= c["i"]) & (c["i"] < r["at"] + r["len"])),
                F.lit(0),
            ).alias("run"),
        ),
    )
    lead = F.when(F.get(runs, F.lit(0))["op"] == "I", 1).otherwise(0)

    def place(c):
        run = c["run"]
        in_ins = run["op"] == "I"
        inserted = run["i"] + F.when(in_ins, c["i"] - run["at"] + 1).otherwise(0) - lead
        before = F.when(c["i"] == run["at"], run["prev"]).otherwise(run["op"])
        loc = pos + c["i"] - rc + run["d"] - inserted
        loc = loc - F.when(reverse & (before == "D"), run["gap"]).otherwise(0)
        return F.struct(
            loc.cast("bigint").alias("loc"),
            c["call"].alias("call"),
            F.when(reverse, before == "I").otherwise(in_ins).alias("ins"),
        )

    return F.when(runs.isNull(), simple).otherwise(F.transform(looked_up, place))


def place_calls(sam: DataFrame, version: str = "canonical", mode: str = "fail") -> DataFrame:
    """One row per counted read: ``line_no,qname,chrom,paired,calls``.

    ``version='old'`` also counts secondary records and compares all paired segments.
    Alignments with other operations than M, I and D, or starting with D, cannot be
    placed: they fail, or are left out with ``mode='permissive'``.
    """
    if version not in ("canonical", "old"):
        raise ValueError("version must be 'canonical' or 'old'")
    skip = s.NOT_PRIMARY_OR_UNMAPPED if version == "canonical" else s.UNMAPPED
    unplaced = ~F.col("cigar").rlike(r"^(\d+[MI])(\d+[MID])*$")
    reads = sam.filter(~s.flag(F.col("flag"), skip))
    if mode == "permissive":
        reads = reads.filter(~unplaced)
    elif mode == "fail":
        problem = F.concat(F.lit("cannot place calls of alignment "), F.col("cigar"))
        reads = reads.withColumn(
            "cigar",
            F.when(unplaced, F.raise_error(problem).cast("string")).otherwise(F.col("cigar")),
        )
    else:
        raise ValueError("mode must be 'fail' or 'permissive'")
    paired = s.flag(F.col("flag"), s.PAIRED)
    if version == "canonical":
        paired = paired & ((F.col("rnext") == F.col("rname")) | (F.col("rnext") == "="))
    return (
        reads.select(
            "line_no",
            "qname",
            F.col("rname").alias("chrom"),
            "pos",
            "cigar",
            paired.alias("paired"),
            (s.tag(F.col("tags"), "XG") == "GA").alias("reverse"),
            _call_indexes(s.tag(F.col("tags"), "XM")).alias("_idx"),
        )
        .withColumn(
            "_runs",
            F.when(~F.col("cigar").rlike(r"^\d+M$"), _segments(F.col("cigar"))),
        )
        .select(
            "line_no",
            "qname",
            "chrom",
            "paired",
            call_array(F.col("pos"), F.col("_runs"), F.col("_idx"), F.col("reverse"))
            .cast(CALL_TYPE)
            .alias("calls"),
        )
    )


def read_calls(sam: DataFrame, version: str = "canonical", mode: str = "fail") -> DataFrame:
    """``line_no,qname,chrom,calls`` per counted read, mate overlaps removed.

    The placed calls, a small part of the records, are written once: the mate comparison
    reads them several times, the alignments are scanned once.
    """
    placed = cut_lineage(place_calls(sam, version, mode))
    return _drop_mate_overlaps(placed, by_chrom=version == "old")


def _drop_mate_overlaps(placed: DataFrame, by_chrom: bool) -> DataFrame:
    """Later segments of a template skip the sites its first record has called.

    The first record is a partial aggregate per name, so a name shared by very many
    records costs one row per task; the join back may split it.
    """
    columns = ["line_no", "qname", "chrom", "calls"]
    single = placed.filter(~F.col("paired")).select(*columns)
    paired = placed.filter("paired").select(*columns)
    firsts = paired.groupBy("qname").agg(
        F.min(
            F.struct(
                F.col("line_no").alias("line_no"),
                F.col("chrom").alias("chrom"),
                F.transform("calls", lambda c: c["loc"]).alias("locs"),
            )
        ).alias("first")
    )
    joined = paired.join(firsts, "qname", "left")
    blocked = F.col("line_no") != F.col("first.line_no")
    if by_chrom:
        blocked = blocked & (F.col("chrom") == F.col("first.chrom"))
    kept = F.when(
        blocked,
        F.filter("calls", lambda c: ~F.array_contains(F.col("first.locs"), c["loc"])),
    ).otherwise(F.col("calls"))
    return single.unionByName(joined.select("line_no", "qname", "chrom", kept.alias("calls")))


def cpg_calls(sam: DataFrame, version: str = "canonical", mode: str = "fail") -> DataFrame:
    """One row per call: ``line_no,qname,chrom,loc,call,ins``. ``ins`` marks sites that
    only an insertion creates; they count in totals but not per site."""
    return unfold_calls(read_calls(sam, version, mode), "line_no", "qname", "chrom")


def unfold_calls(reads: DataFrame, *columns: str) -> DataFrame:
    """One row per call. The outer form keeps the optimizer from copying the whole call
    expression into a size filter below."""
    return reads.select(*columns, F.inline_outer("calls")).filter(F.col("call").isNotNull())


def cpg_counts(calls: DataFrame, min_cov: int = 1) -> DataFrame:
    """``chrom,pos,meth,unmeth,pct`` for sites with at least ``min_cov`` calls."""
    return (
        calls.filter(~F.col("ins"))
        .groupBy("chrom", F.col("loc").alias("pos"))
        .agg(
            F.count_if(F.col("call") == "Z").alias("meth"),
            F.count_if(F.col("call") == "z").alias("unmeth"),
        )
        .filter(F.col("meth") + F.col("unmeth") >= max(min_cov, 1))
        .withColumn("pct", 100.0 * F.col("meth") / (F.col("meth") + F.col("unmeth")))
    )


def cpg_summary(sam: DataFrame, version: str = "canonical", mode: str = "fail") -> DataFrame:
    """One row: reads, mapped reads, calls, methylated and unmethylated calls, percent."""
    counted = F.lit(True)
    if version == "canonical":
        counted = ~s.flag(F.col("flag"), s.NOT_PRIMARY)
    none = F.lit(None).cast("bigint")
    reads = sam.filter(counted).agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if(~s.flag(F.col("flag"), s.UNMAPPED)).alias("mapped"),
    )
    totals = read_calls(sam, version, mode).agg(
        F.sum(F.size("calls")).alias("calls"),
        F.sum(F.size(F.filter("calls", lambda c: c["call"] == "Z"))).alias("methylated"),
    )
    # Two rows of totals side by side, without a join.
    both = reads.select("*", none.alias("calls"), none.alias("methylated")).unionByName(
        totals.select("*", none.alias("reads"), none.alias("mapped"))
    )
    return both.agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("reads", "mapped", "calls", "methylated")]
    ).select(
        "reads",
        "mapped",
        "calls",
        "methylated",
        (F.col("calls") - F.col("methylated")).alias("unmethylated"),
        F.try_divide(100.0 * F.col("methylated"), F.col("calls").cast("double")).alias("pct"),
    )
