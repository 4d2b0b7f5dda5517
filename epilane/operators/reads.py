"""Filters and conversions of alignment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.functions import sam as s
from epilane.functions.cigar import cigar_indel
from epilane.functions.sequence import rev_comp, rev_qual
from epilane.operators.ordered import running
from epilane.session import cut_lineage

# Where a read counts as placed when copies are sought. Positions differ most, so sorts
# that begin with them seldom look further.
PLACE = ["loc", "rname", "reverse"]


def filter_reads(sam: DataFrame, names: DataFrame, keep: bool = True) -> DataFrame:
    """Records whose name is (``keep=False``: is not) in ``names.qname``."""
    listed = names.select("qname").distinct()
    return sam.join(listed, "qname", "left_semi" if keep else "left_anti").select(*sam.columns)


def to_intervals(sam: DataFrame) -> DataFrame:
    """Primary mapped records with 0-based ``start`` and ``end`` on the reference."""
    start = F.col("pos") - 1
    return (
        sam.filter(~s.flag(F.col("flag"), s.NOT_PRIMARY_OR_UNMAPPED))
        .withColumn("start", start)
        .withColumn("end", start + F.length("seq") + cigar_indel(F.col("cigar")))
        .withColumn("reverse", s.flag(F.col("flag"), s.REVERSE))
        .withColumn("proper", s.flag(F.col("flag"), s.PROPER))
    )


def pair_extent(reads: DataFrame) -> DataFrame:
    """``chrom,start,end,qname`` of properly paired fragments, from the 5' end of each
    mate; a lone mate gives nothing, a third record fails."""
    five_prime = F.when(F.col("reverse"), F.col("end")).otherwise(F.col("start"))
    over = F.raise_error(F.concat(F.lit("read already analyzed: "), F.col("qname")))
    return (
        reads.groupBy("qname")
        .agg(
            F.min(five_prime).alias("start"),
            F.max(five_prime).alias("end"),
            F.count(F.lit(1)).alias("records"),
            F.max_by("rname", "line_no").alias("chrom"),
        )
        .filter(F.when(F.col("records") > 2, over.cast("boolean")).otherwise(F.col("records") == 2))
        .select("chrom", "start", "end", "qname")
    )


def sam_to_bed(
    sam: DataFrame, chroms: DataFrame | None = None, unpaired: str = "no", extend: int = 0
) -> DataFrame:
    """Fragments ``chrom,start,end,qname,clamped`` of proper pairs and, if wanted,
    unpaired reads (``'yes'`` as aligned, ``'extend'`` to ``extend`` bases).

    Fragments are clamped to the chromosome; ``clamped`` marks those changed.
    """
    if unpaired not in ("no", "yes", "extend"):
        raise ValueError("unpaired must be 'no', 'yes' or 'extend'")
    reads = to_intervals(sam)
    found = pair_extent(reads.filter("proper"))
    if unpaired != "no":
        start, end = F.col("start"), F.col("end")
        if unpaired == "extend":
            start, end = (
                F.when(F.col("reverse"), F.least(end - extend, start)).otherwise(start),
                F.when(F.col("reverse"), end).otherwise(F.greatest(start + extend, end)),
            )
        found = found.unionByName(
            reads.filter(~F.col("proper")).select(
                F.col("rname").alias("chrom"), start.alias("start"), end.alias("end"), "qname"
            )
        )
    limit = F.lit(None).cast("bigint")
    if chroms is not None:
        found = found.join(chroms.select("chrom", F.col("length").alias("limit")), "chrom", "left")
        limit = F.col("limit")
    low, high = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("end"), limit)
    return found.select(
        "chrom",
        low.cast("bigint").alias("start"),
        high.cast("bigint").alias("end"),
        "qname",
        ((low != F.col("start")) | (high != F.col("end"))).alias("clamped"),
    )


def _fastq(reads: DataFrame, name: Column, *more) -> DataFrame:
    reverse = s.flag(F.col("flag"), s.REVERSE)
    return reads.select(
        *more,
        name.alias("name"),
        F.when(reverse, rev_comp(F.col("seq"), "drop")).otherwise(F.col("seq")).alias("seq"),
        F.when(reverse, rev_qual(F.col("qual"))).otherwise(F.col("qual")).alias("qual"),
    )


def sam_to_fastq(sam: DataFrame) -> DataFrame:
    """``name,seq,qual``: the first primary record of each read name."""
    first = (
        sam.filter(~s.flag(F.col("flag"), s.NOT_PRIMARY))
        .groupBy("qname")
        .agg(F.min(F.struct("line_no", "flag", "seq", "qual")).alias("r"))
        .select("qname", "r.*")
    )
    return _fastq(first, F.col("qname"))


def sam_to_fastq_pe(sam: DataFrame) -> DataFrame:
    """``end,pair,name,seq,qual`` with ``end`` in ``1``, ``2``, ``unpaired``, ``orphan``.

    ``pair`` is the line of the first record of a pair, or of a record alone: in its
    order the mates of ``1`` and ``2`` stand in step.

    Records of a name are read in file order. A proper record pairs with the proper
    record before it if their coordinates point at each other; a record that is not
    proper is written by itself. Whatever comes first closes the name.
    """
    records = sam.filter(~s.flag(F.col("flag"), s.NOT_PRIMARY))
    narrow = records.select(
        "qname", "line_no", "pos", "pnext", s.flag(F.col("flag"), s.PROPER).alias("proper")
    )
    here = F.when(F.col("proper"), F.struct("line_no", "pos", "pnext"))
    linked = running(
        narrow,
        ["qname"],
        ["line_no"],
        {"prev": ("max", here)},
        F.shiftright("line_no", 20),
        inclusive=False,
    )
    mated = F.col("proper") & F.coalesce(
        (F.col("prev.pos") == F.col("pnext")) & (F.col("prev.pnext") == F.col("pos")),
        F.lit(False),
    )
    event = F.struct(
        F.col("line_no").alias("line"), mated.alias("mated"), F.col("prev.line_no").alias("before")
    )
    closed = linked.groupBy("qname").agg(
        F.min(F.when(~F.col("proper") | mated, event)).alias("close"),
        F.max(F.when(F.col("proper"), F.col("line_no"))).alias("last"),
    )

    def place(line, end, pair=None):
        pair = line if pair is None else pair
        return F.struct(line.alias("line_no"), F.lit(end).alias("end"), pair.alias("pair"))

    line, before = F.col("close.line"), F.col("close.before")
    places = (
        F.when(F.col("close").isNull(), F.array(place(F.col("last"), "orphan")))
        .when(F.col("close.mated"), F.array(place(before, "1"), place(line, "2", before)))
        .otherwise(F.array(place(line, "unpaired"), place(before, "orphan")))
    )
    # Some numbers for each record written: stored, so that what led to them goes before the
    # texts are dealt.
    decided = cut_lineage(closed.select(F.inline(places)).filter(F.col("line_no").isNotNull()))
    suffix = (
        F.when(F.col("end").isin("1", "orphan"), F.lit(" /1"))
        .when(F.col("end") == "2", F.lit(" /2"))
        .otherwise(F.lit(""))
    )
    return _fastq(records.join(decided, "line_no"), F.concat("qname", suffix), "end", "pair")


def alignments_per_read(sam: DataFrame) -> DataFrame:
    """``qname,first,last``: mapped alignments per read name and segment."""
    last = s.segment(F.col("flag")) == 1
    return (
        sam.filter(~s.flag(F.col("flag"), s.UNMAPPED))
        .groupBy("qname")
        .agg(F.count_if(~last).alias("first"), F.count_if(last).alias("last"))
    )


def read_score(sam: DataFrame) -> DataFrame:
    """``qname,kind,score``: summed Phred scores of primary mapped records; for pairs
    the sum of both mates, for single reads the last record in the file."""
    from epilane.operators.duplicates import read_scores

    return read_scores(sam)


def dedup_reads(sam: DataFrame, by: str = "seq", keep_unmapped: bool = False) -> DataFrame:
    """One record per position, strand and (``by``) ``seq`` or ``xm`` string, or the
    most frequent sequence (``'consensus'``). Reverse reads are placed at their 3' end.

    For ``seq`` and ``xm`` a partial aggregate keeps the first record per key, so copies of
    one fragment collapse before they are shuffled. For ``consensus`` the records are dealt
    by place once, and both steps follow one sort. Records are carried whole: leave out
    columns that are not wanted beforehand.
    """
    if by not in ("seq", "xm", "consensus"):
        raise ValueError("by must be 'seq', 'xm' or 'consensus'")
    keyed = _dedup_keys(sam, keep_unmapped)
    if by == "consensus":
        keyed = _by_place(keyed)
    place = PLACE
    if by == "xm":
        keyed = keyed.withColumn("xm", s.tag(F.col("tags"), "XM"))
    sub = ["xm"] if by == "xm" else ["seq"]
    record = F.struct(*[F.col(c) for c in sam.columns])
    firsts = keyed.groupBy(*place, *sub).agg(
        F.min_by(record, "line_no").alias("record"), F.count(F.lit(1)).alias("copies")
    )
    if by == "consensus":
        rank = F.struct("copies", -F.col("record.line_no"))
        firsts = firsts.groupBy(*place).agg(F.max_by("record", rank).alias("record"))
    return firsts.select("record.*")


def _by_place(keyed: DataFrame) -> DataFrame:
    """Rows of a place in one of many tasks, apart from the task that made them: nearly all
    places have a few reads, which no task upstream can collapse."""
    tasks = 16 * keyed.sparkSession.sparkContext.defaultParallelism
    return keyed.repartition(tasks, *PLACE)


def top_sequence(sam: DataFrame) -> DataFrame:
    """``rname,loc,reverse,seq,copies``: the most frequent sequence of each position and
    strand; of equally frequent ones the first seen."""
    place = PLACE
    counted = _by_place(_dedup_keys(sam, False)).groupBy(*place, "seq").agg(
        F.count(F.lit(1)).alias("copies"), F.min("line_no").alias("line_no")
    )
    best = F.max_by(F.struct("seq", "copies"), F.struct("copies", -F.col("line_no")))
    return counted.groupBy(*place).agg(best.alias("best")).select("rname", "loc", "reverse", "best.*")


def _dedup_keys(sam: DataFrame, keep_unmapped: bool) -> DataFrame:
    reverse = s.flag(F.col("flag"), s.REVERSE)
    loc = F.when(
        reverse, F.col("pos") + F.length("seq") + cigar_indel(F.col("cigar"))
    ).otherwise(F.col("pos"))
    reads = sam if keep_unmapped else sam.filter(~s.flag(F.col("flag"), s.UNMAPPED))
    return reads.withColumns({"loc": loc.cast("bigint"), "reverse": reverse})


def dedup_summary(sam: DataFrame, by: str = "seq", keep_unmapped: bool = False) -> DataFrame:
    """One row: reads, first reads at a position, new sequences at a used position,
    repeats."""
    keyed = _dedup_keys(sam, keep_unmapped)
    place = PLACE
    if by == "xm":
        keyed = keyed.withColumn("xm", s.tag(F.col("tags"), "XM"))
    sub = ["xm"] if by == "xm" else ["seq"]
    variants = _by_place(keyed).groupBy(*place, *sub).agg(F.count(F.lit(1)).alias("copies"))
    places = variants.groupBy(*place).agg(
        F.sum("copies").alias("reads"), F.count(F.lit(1)).alias("variants")
    )
    return places.agg(
        F.sum("reads").alias("reads"),
        F.count(F.lit(1)).alias("uniq"),
        F.sum(F.col("variants") - 1).alias("not_seq"),
        F.sum(F.col("reads") - F.col("variants")).alias("dups"),
    )
