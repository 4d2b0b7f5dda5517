"""Finding likely PCR duplicates among alignments.

A read is a duplicate if any of its alignment keys is already owned by a better
read. With several alignments per read that is a greedy choice in order of quality.
It is solved here by rounds over a (read, key) table: a read that is best in all its
keys is kept, the reads sharing a key with it are duplicates, and both leave. Keys
held by very many reads only meet partial aggregates and splittable joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epilane.functions import sam as s
from epilane.functions.cigar import cigar_clip, cigar_ref_len, cigar_splices
from epilane.functions.sequence import phred_sum
from epilane.operators.ordered import running
from epilane.session import Scratch, cut_lineage

MODES = ("clip", "tophat", "picard")
RESULT = ["qname", "aln", "parent", "type"]


def _quoted(col: Column) -> Column:
    return F.concat(F.lit("'"), col, F.lit("'"))


def _key_text(chrom: Column, pos: Column, splices: Column | None, spliced: Column, strand: Column) -> Column:
    """Report format of a key: ``('chr1', 100, ('5-20',), '+')``."""
    parts = [_quoted(chrom), pos.cast("string")]
    if splices is not None:
        listed = F.array_join(F.transform(splices, _quoted), ", ")
        comma = F.when(F.size(splices) == 1, F.lit(",")).otherwise(F.lit(""))
        parts.append(F.when(spliced, F.concat(F.lit("("), listed, comma, F.lit(")"))).otherwise("()"))
    parts.append(_quoted(strand))
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def alignment_keys(sam: DataFrame, mode: str = "clip", paired: bool = True) -> DataFrame:
    """Mapped records with their duplicate key, segment, pairing and score.

    ``clip`` moves the key to the true start over soft clips and treats 0x1 unset as
    single; ``tophat`` and ``picard`` look at 0x8 only; ``picard`` skips secondary
    records and leaves splices out of the key.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    flag, cigar, pos = F.col("flag"), F.col("cigar"), F.col("pos")
    skip = s.UNMAPPED | s.SECONDARY if mode == "picard" else s.UNMAPPED
    reverse = s.flag(flag, s.REVERSE)
    shift = cigar_clip(cigar) if mode == "clip" else F.lit(0)
    at = pos + shift + F.when(reverse, cigar_ref_len(cigar)).otherwise(F.lit(0))
    if mode != "clip":
        reverse = reverse & (cigar_ref_len(cigar) > 0)
    splices = None if mode == "picard" else cigar_splices(cigar, reverse)
    strand = F.when(reverse, F.lit("-")).otherwise(F.lit("+"))
    if not paired:
        is_pair = F.lit(False)
    elif mode == "clip":
        is_pair = s.is_pair(flag)
    else:
        is_pair = ~s.flag(flag, s.MATE_UNMAPPED)
    segment = (
        s.segment(flag) if mode == "clip" else s.flag(flag, s.SEGMENT_LAST).cast("int")
    )
    mate_chrom = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    return sam.filter(~s.flag(flag, skip)).select(
        "line_no",
        "qname",
        _key_text(F.col("rname"), at, splices, F.contains(cigar, F.lit("N")), strand).alias("key"),
        segment.alias("segment"),
        is_pair.alias("is_pair"),
        (~s.flag(flag, s.NOT_PRIMARY)).alias("primary"),
        s.tag(F.col("tags"), "HI", required=False).alias("hi"),
        phred_sum(F.col("qual")).alias("score"),
        F.concat_ws(":", "rname", "pos").alias("place"),
        F.when((mate_chrom != "*") & (F.col("pnext") != 0), F.concat_ws(":", mate_chrom, "pnext")).alias(
            "mate_place"
        ),
    )


def _scores(keyed: DataFrame) -> DataFrame:
    primary = keyed.filter("primary")
    pairs = primary.filter("is_pair").groupBy("qname").agg(F.sum("score").alias("score"))
    singles = primary.filter(~F.col("is_pair")).groupBy("qname").agg(
        F.max_by("score", "line_no").alias("score")
    )
    return pairs.withColumn("kind", F.lit("pair")).unionByName(
        singles.withColumn("kind", F.lit("single"))
    )


def read_scores(sam: DataFrame, mode: str = "clip") -> DataFrame:
    """``qname,kind,score`` of reads with a primary record."""
    return _scores(alignment_keys(sam, mode)).select("qname", "kind", "score")


def _fail(text: str, qname: str = "qname") -> Column:
    return F.raise_error(F.concat(F.lit(text + " for read "), F.col(qname)))


def rank_reads(scores: DataFrame) -> DataFrame:
    """Reads by falling score; equal scores by name."""
    return scores.orderBy(F.col("score").desc(), "qname")


def pair_by_hi(keyed: DataFrame, by_segment: bool = True) -> DataFrame:
    """``qname,slot,line_no,aln0,aln1`` from records that share a hit index.

    Sides are the segments, or the first and second record in the file. More than
    one record per side fails.
    """
    grouped = keyed.groupBy("qname", "slot")
    if by_segment:
        first, last = F.col("segment") == 0, F.col("segment") == 1
        return (
            grouped.agg(
                F.min("line_no").alias("line_no"),
                F.count_if(first).alias("n0"),
                F.count_if(last).alias("n1"),
                F.max(F.when(first, F.col("key"))).alias("aln0"),
                F.max(F.when(last, F.col("key"))).alias("aln1"),
            )
            .withColumn(
                "aln0",
                F.when(
                    (F.col("n0") > 1) | (F.col("n1") > 1),
                    _fail("several records on one side of a hit").cast("string"),
                ).otherwise(F.col("aln0")),
            )
            .drop("n0", "n1")
        )
    return (
        grouped.agg(
            F.min("line_no").alias("line_no"),
            F.count(F.lit(1)).alias("n"),
            F.min_by("key", "line_no").alias("aln0"),
            F.max_by("key", "line_no").alias("aln1"),
        )
        .withColumn("aln1", F.when(F.col("n") == 2, F.col("aln1")).when(
            F.col("n") > 2, _fail("three or more records under one hit index").cast("string")
        ))
        .drop("n")
    )


# Reads of more records than this have them dealt over tasks by the place in the file.
CROWDED = 1 << 16


def pair_by_coord(secondary: DataFrame, primary: DataFrame) -> DataFrame:
    """Pair secondary records without hit index by reciprocal coordinates.

    Within one read and one pair of coordinates the records come in file order. The
    i-th record of the segment seen first waits for the i-th of the other one. Once the
    other segment runs ahead, every further record opens a pair of its own with the
    latest record of the opposite segment. What still waits takes the primary mate.

    Records are dealt by read once, and all steps follow in the same task; only reads of
    very many records go over several tasks.
    """
    sizes = secondary.groupBy("qname").agg(F.count(F.lit(1)).alias("n"))
    crowded = cut_lineage(sizes.filter(F.col("n") > CROWDED).select("qname"))
    if crowded.isEmpty():
        return _coord_pairs(secondary, primary, False)
    most, few = (secondary.join(crowded, "qname", kind) for kind in ("left_semi", "left_anti"))
    return _coord_pairs(few, primary, False).unionByName(_coord_pairs(most, primary, True))


def _coord_pairs(secondary: DataFrame, primary: DataFrame, spread: bool) -> DataFrame:
    """The pairs of ``pair_by_coord``. ``spread`` deals the records of a read over tasks."""
    needed = F.when(
        F.col("mate_place").isNull(), _fail("no mate position on a secondary record").cast("string")
    ).otherwise(F.col("mate_place"))
    first = F.col("segment") == 0
    narrow = secondary.select("qname", "line_no", "segment", "key", "place", "mate_place")
    dealt = narrow if spread else narrow.filter(F.col("qname").isNotNull()).repartition("qname")
    classed = dealt.withColumn("mate_place", needed).select(
        "qname",
        "line_no",
        "segment",
        "key",
        F.when(first, F.col("place")).otherwise(F.col("mate_place")).alias("c0"),
        F.when(first, F.col("mate_place")).otherwise(F.col("place")).alias("c1"),
    )
    cls = ["qname", "c0", "c1"]
    here = F.struct("line_no", "key")
    aggs = {
        "n0": ("sum", F.when(first, 1).otherwise(0)),
        "n1": ("sum", F.when(first, 0).otherwise(1)),
        "last0": ("max", F.when(first, here)),
        "last1": ("max", F.when(~first, here)),
        "head": ("min", F.struct("line_no", "segment")),
    }
    if spread:
        tracked = running(classed, cls, ["line_no"], aggs, F.shiftright("line_no", 20))
    else:
        so_far = W.partitionBy(*cls).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
        folds = {"sum": F.sum, "max": F.max, "min": F.min}
        tracked = classed.withColumns(
            {name: folds[kind](col).over(so_far) for name, (kind, col) in aggs.items()}
        )
    lead = F.col("head.segment")
    n_lead = F.when(lead == 0, F.col("n0")).otherwise(F.col("n1"))
    n_other = F.when(lead == 0, F.col("n1")).otherwise(F.col("n0"))
    is_lead = F.col("segment") == lead
    marked = tracked.withColumns(
        {"is_lead": is_lead, "lead": lead, "nth": F.when(is_lead, n_lead).otherwise(n_other)}
    )
    ahead_line = F.min(F.when(~is_lead & (n_other > n_lead), F.col("line_no")))
    if spread:
        ahead = marked.groupBy(*cls).agg(ahead_line.alias("ahead_line"))
        staged = marked.join(ahead, cls)
    else:
        staged = marked.withColumn("ahead_line", ahead_line.over(W.partitionBy(*cls)))
    staged = staged.withColumn(
        "waits", F.col("ahead_line").isNull() | (F.col("line_no") < F.col("ahead_line"))
    )
    own = F.when(~F.col("waits"), F.when(first, F.col("last1.key")).otherwise(F.col("last0.key")))
    primaries = primary.select("qname", F.col("aln0").alias("p0"), F.col("aln1").alias("p1"))
    if spread:
        late = staged.filter(~F.col("waits")).select(
            "qname",
            "line_no",
            F.when(first, F.col("key")).otherwise(own).alias("aln0"),
            F.when(first, own).otherwise(F.col("key")).alias("aln1"),
        )
        early = staged.filter("waits")
        answers = early.filter(~F.col("is_lead")).select(*cls, "nth", F.col("key").alias("answer"))
        waiting = (
            early.filter("is_lead")
            .select(*cls, "nth", "line_no", "segment", "key")
            .join(answers, [*cls, "nth"], "left")
            .join(primaries, "qname", "left")
        )
        mate = F.coalesce("answer", F.when(first, F.col("p1")).otherwise(F.col("p0")))
        met = waiting.select(
            "qname",
            "line_no",
            F.when(first, F.col("key")).otherwise(mate).alias("aln0"),
            F.when(first, mate).otherwise(F.col("key")).alias("aln1"),
        )
        return met.unionByName(late)
    # The waiting record and its answer stand under the same number.
    met = W.partitionBy(*cls, "waits", "nth")
    answer = F.max(F.when(F.col("waits") & ~F.col("is_lead"), F.col("key"))).over(met)
    opened = (
        staged.select(*cls, "waits", "is_lead", "nth", "line_no", "segment", "key", own.alias("own"))
        .withColumn("answer", answer)
        .filter(~F.col("waits") | F.col("is_lead"))
        .join(primaries, "qname", "left")
    )
    waited = F.coalesce("answer", F.when(first, F.col("p1")).otherwise(F.col("p0")))
    mate = F.when(F.col("waits"), waited).otherwise(F.col("own"))
    return opened.select(
        "qname",
        "line_no",
        F.when(first, F.col("key")).otherwise(mate).alias("aln0"),
        F.when(first, mate).otherwise(F.col("key")).alias("aln1"),
    )


def pair_reads(keyed: DataFrame, mode: str = "clip", incomplete: str = "fail") -> DataFrame:
    """``qname,line_no,aln0,aln1``: the pairs of every read with paired alignments.

    A pair lacking one side fails, or is left out with ``incomplete='drop'``.
    """
    if incomplete not in ("fail", "drop"):
        raise ValueError("incomplete must be 'fail' or 'drop'")
    pairs = keyed.filter("is_pair")
    if mode == "picard":
        found = pairs.groupBy("qname").agg(
            F.min("line_no").alias("line_no"),
            F.min_by("key", "line_no").alias("aln0"),
            F.when(F.count(F.lit(1)) > 1, F.max_by("key", "line_no")).alias("aln1"),
        )
    elif mode == "tophat":
        found = pair_by_hi(
            pairs.withColumn("slot", F.coalesce("hi", F.lit("-1"))), by_segment=False
        ).drop("slot")
    else:
        no_index = F.col("hi").isNull()
        indexed = pair_by_hi(pairs.filter(~no_index).withColumn("slot", F.col("hi")))
        primary = pair_by_hi(
            pairs.filter(no_index & F.col("primary")).withColumn("slot", F.lit("primary"))
        )
        found = reduce(
            DataFrame.unionByName,
            [
                indexed.drop("slot"),
                primary.drop("slot"),
                pair_by_coord(pairs.filter(no_index & ~F.col("primary")), primary),
            ],
        )
    lacking = F.col("aln0").isNull() | F.col("aln1").isNull()
    if incomplete == "drop":
        return found.filter(~lacking)
    return found.withColumn(
        "aln0",
        F.when(lacking, _fail("one side only of a pair").cast("string")).otherwise(F.col("aln0")),
    )


def _pair_key() -> Column:
    return F.concat(
        F.lit("("), F.least("aln0", "aln1"), F.lit(", "), F.greatest("aln0", "aln1"), F.lit(")")
    )


def match_keys(edges: DataFrame, owners: DataFrame, kind: str) -> DataFrame:
    """Report rows: the first key of a read, in its own order, that a better read owns."""
    better = F.col("owner_rank").isNull() | (F.col("owner_rank") < F.col("rank"))
    return (
        edges.join(owners, "key")
        .filter(better)
        .groupBy("qname")
        .agg(F.min(F.struct("ord", "key", "parent")).alias("hit"))
        .select(
            "qname",
            F.concat(F.lit("aln:"), "hit.key").alias("aln"),
            F.col("hit.parent").alias("parent"),
            F.lit(kind).alias("type"),
        )
    )


def _greedy(
    edges: DataFrame, owned: DataFrame | None, kind: str, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """Duplicates and the kept reads' keys, for ``edges(qname,rank,ord,key)``.

    ``owned(key,parent,owner_rank)`` holds keys taken beforehand. Reads of one key decide
    by one grouped minimum, unless a read of several keys shares it; only the reads around
    those go through rounds, whose states are a part of the table of their own. With
    ``scratch``, whose tables ``edges`` must come from, a state goes when the next one is
    written.
    """

    def store(df, name):
        return cut_lineage(df) if scratch is None else scratch.table(df, f"{kind}-{name}")

    def drop(*names):
        if scratch is not None:
            scratch.drop(*(f"{kind}-{name}" for name in names))

    edges = edges if scratch is not None else cut_lineage(edges)
    open_ = edges.drop("ord")
    if owned is not None:
        taken = edges.join(owned, "key", "left_semi").select("qname").distinct()
        open_ = open_.join(taken, "qname", "left_anti")
    ends = open_.groupBy("qname").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    many = ends.filter("low <> high").select("qname")
    # All keys of a read of several keys are shared ones, so no read has keys of both kinds.
    shared = store(open_.join(many, "qname", "left_semi").select("key").distinct(), "shared")
    marked = store(
        open_.join(shared.withColumn("shared", F.lit(True)), "key", "left").withColumn(
            "shared", F.coalesce("shared", F.lit(False))
        ),
        "marked",
    )
    drop("shared")
    owners = store(_best_owner(marked.filter(~F.col("shared"))), "alone")
    owners = owners if owned is None else owned.unionByName(owners)
    pending, past, step = marked.filter("shared").drop("shared"), "marked", 0
    while not pending.isEmpty():
        heads = pending.groupBy("key").agg(F.min("rank").alias("head"))
        winners = (
            pending.join(heads, "key")
            .groupBy("qname")
            .agg(F.bool_and(F.col("rank") == F.col("head")).alias("won"))
        )
        state = store(pending.join(winners, "qname"), f"state{step}")
        drop(past)
        kept = store(
            state.filter("won")
            .select("key", F.col("qname").alias("parent"), F.col("rank").alias("owner_rank"))
            .distinct(),
            f"kept{step}",
        )
        owners = owners.unionByName(kept)
        rest = state.filter(~F.col("won")).drop("won")
        beaten = rest.join(kept, "key", "left_semi").select("qname").distinct()
        pending = store(rest.join(beaten, "qname", "left_anti"), f"pending{step}")
        drop(f"state{step}")
        past, step = f"pending{step}", step + 1
    drop(past)
    return match_keys(edges, owners, kind), owners


def _best_owner(rows: DataFrame) -> DataFrame:
    """``key,parent,owner_rank`` with the smallest rank per key."""
    return (
        rows.groupBy("key")
        .agg(F.min(F.struct("rank", "qname")).alias("o"))
        .select("key", F.col("o.qname").alias("parent"), F.col("o.rank").alias("owner_rank"))
    )


def find_dups(
    sam: DataFrame,
    mode: str = "clip",
    rank: str = "score",
    paired: bool = True,
    incomplete: str = "fail",
) -> DataFrame:
    """``qname,aln,parent,type`` of duplicate reads, pairs first, then single reads.

    ``rank='score'`` prefers high summed quality (ties: name); ``rank='input'`` takes
    first-seen order. ``mode='picard'`` is always first-seen with one key per read.
    ``paired=False`` treats every alignment as single.
    """
    if rank not in ("score", "input"):
        raise ValueError("rank must be 'score' or 'input'")
    if mode != "picard" and rank == "score":
        with Scratch(sam.sparkSession) as scratch:
            return scratch.result(_find_ranked(alignment_keys(sam, mode, paired), mode, incomplete, scratch))
    # Several passes read the keys; they are a small part of a record, so they are
    # written once.
    keyed = cut_lineage(alignment_keys(sam, mode, paired))
    singles = keyed.filter(~F.col("is_pair"))
    pairs = pair_reads(keyed, mode, incomplete).withColumn("key", _pair_key())
    if mode == "picard":
        return _find_picard(pairs, singles)
    return _find_first_seen(pairs, singles)


def _find_ranked(keyed: DataFrame, mode: str, incomplete: str, scratch: Scratch) -> DataFrame:
    """Duplicates by score. Each step is stored, and removed when no later one reads it."""
    keyed = scratch.table(keyed, "keyed")
    scores = scratch.table(
        _scores(keyed).withColumn("rank", F.struct(-F.col("score"), F.col("qname"))), "scores"
    )

    def ranked(rows, kind, *columns):
        mine = scores.filter(F.col("kind") == kind).select("qname", "rank")
        return rows.join(mine, "qname").select("qname", "rank", F.col("line_no").alias("ord"), *columns)

    pairs = scratch.table(pair_reads(keyed, mode, incomplete), "pairs")
    singles = scratch.table(ranked(keyed.filter(~F.col("is_pair")), "single", "key"), "singles")
    scratch.drop("keyed")
    # The key of a pair is made of its ends again where it is read.
    pair_edges = scratch.table(ranked(pairs, "pair", "aln0", "aln1"), "edges")
    scratch.drop("pairs", "scores")
    edges = pair_edges.select("qname", "rank", "ord", _pair_key().alias("key"))
    pair_dups, pair_owners = _greedy(edges, None, "paired-end", scratch)
    if singles.isEmpty():
        return pair_dups
    kept = pair_edges.join(
        pair_owners.select(F.col("parent").alias("qname")).distinct(), "qname", "left_semi"
    )
    ends = _best_owner(
        kept.select("qname", "rank", F.explode(F.array("aln0", "aln1")).alias("key"))
    ).withColumn("owner_rank", F.lit(None).cast(pair_edges.schema["rank"].dataType))
    single_dups, _ = _greedy(singles, scratch.table(ends, "ends"), "single-end", scratch)
    return pair_dups.unionByName(single_dups)


def _find_first_seen(pairs: DataFrame, singles: DataFrame) -> DataFrame:
    """A key belongs to the first read having it, whether or not that read is itself a
    duplicate; only pairs that open a new key pass their ends on to single reads."""

    def with_rank(rows, stage):
        first = rows.groupBy("qname").agg(F.min("line_no").alias("first_line"))
        ranked = rows.join(first, "qname").withColumn(
            "rank", F.struct(F.lit(stage).alias("stage"), "first_line", "line_no")
        )
        return cut_lineage(ranked)

    pair_rows = with_rank(cut_lineage(pairs), 0)
    single_rows = with_rank(singles.select("qname", "line_no", "key"), 1)
    owners = _best_owner(pair_rows)

    def report(rows, owned, kind):
        hits = rows.join(owned, "key").filter(F.col("parent") != F.col("qname"))
        return (
            hits.groupBy("qname")
            .agg(F.min(F.struct("line_no", "key", "parent")).alias("hit"))
            .select(
                "qname",
                F.concat(F.lit("aln:"), "hit.key").alias("aln"),
                F.col("hit.parent").alias("parent"),
                F.lit(kind).alias("type"),
            )
        )

    opening = pair_rows.join(
        owners.select("key", F.col("owner_rank").alias("rank")), ["key", "rank"], "left_semi"
    )
    ends = opening.select("qname", "rank", F.explode(F.array("aln0", "aln1")).alias("key"))
    single_owners = _best_owner(ends.unionByName(single_rows.select("qname", "rank", "key")))
    return report(pair_rows, owners, "paired-end").unionByName(
        report(single_rows, single_owners, "single-end")
    )


def _find_picard(pairs: DataFrame, singles: DataFrame) -> DataFrame:
    """One key per read: the first read of a key is kept. Single reads are compared with
    all ends of kept pairs, the latest pair naming the parent, then with each other."""
    rows = pairs.withColumn("rank", F.struct("line_no"))
    owners = _best_owner(rows)
    judged = rows.join(owners, "key")
    again = F.col("parent") != F.col("qname")
    pair_dups = judged.filter(again).select(
        "qname",
        F.concat(F.lit("aln:"), "key").alias("aln"),
        "parent",
        F.lit("paired-end").alias("type"),
    )
    ends = (
        judged.filter(~again)
        .select("qname", "line_no", F.explode(F.array("aln0", "aln1")).alias("key"))
        .groupBy("key")
        .agg(F.max_by("qname", "line_no").alias("pair_parent"))
    )
    lone = singles.groupBy("qname").agg(
        F.min("line_no").alias("line_no"),
        F.min_by("key", "line_no").alias("key"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn(
        "key",
        F.when(F.col("n") > 1, _fail("several records on one side of a hit").cast("string")).otherwise(F.col("key")),
    )
    firsts = lone.groupBy("key").agg(F.min_by("qname", "line_no").alias("single_parent"))
    single_dups = (
        lone.join(firsts, "key")
        .join(ends, "key", "left")
        .withColumn("parent", F.coalesce("pair_parent", "single_parent"))
        .filter(F.col("pair_parent").isNotNull() | (F.col("parent") != F.col("qname")))
        .select(
            "qname",
            F.concat(F.lit("aln:"), "key").alias("aln"),
            "parent",
            F.lit("SE->PE").alias("type"),
        )
    )
    return pair_dups.unionByName(single_dups)
