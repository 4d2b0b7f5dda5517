"""Joins of positions, intervals and genome text on a shared axis.

Every join is an equi-join on (keys, level, bin) with the exact range re-checked, so Spark
may broadcast a side it measures as small and otherwise shuffles by bin, where adaptive
execution splits a hot bin. Bins are hierarchical: their widths grow by factors of eight,
and an interval lies in the bins of the first level that is no narrower than itself, which
are two at most. An interval as long as a chromosome is two rows, and a short one never
meets a far point. Which levels occur is asked once per join (a grouped count of a few
rows); data with short intervals only have one level, and points are then not repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.session import cut_lineage

BIN = 1 << 12
GROWTH_BITS = 3
CHUNK = 1 << 16


def _bin(col: Column, size: int) -> Column:
    return F.floor(col / F.lit(size))


def _base_bits(bin_size: int) -> int:
    if bin_size < 1 or bin_size & (bin_size - 1):
        raise ValueError("bin_size must be a power of two")
    return bin_size.bit_length() - 1


def bin_level(start: Column, last: Column, bin_size: int = BIN) -> Column:
    """The first level whose bins are no narrower than ``last - start``."""
    bits = F.when(last > start, F.length(F.bin(last - start))).otherwise(0)
    return F.greatest(F.ceil((bits - _base_bits(bin_size)) / GROWTH_BITS), F.lit(0)).cast("int")


def bin_at(pos: Column, level: Column, bin_size: int = BIN) -> Column:
    """Number of the bin of a level that holds a position."""
    width = F.lit(_base_bits(bin_size)) + level * GROWTH_BITS
    return F.call_function("shiftright", pos.cast("bigint"), F.least(width, F.lit(62)).cast("int"))


def interval_bins(df: DataFrame, start: Column, last: Column, level: Column, bin_size: int = BIN) -> DataFrame:
    """``df`` with ``_level`` and ``_bin``, a row for each of the one or two bins that an
    interval touches on a level no narrower than itself."""
    levelled = df.withColumn("_level", level)
    first, final = (bin_at(x, F.col("_level"), bin_size) for x in (start, last))
    bins = F.when(first == final, F.array(first)).otherwise(F.array(first, final))
    return levelled.withColumn("_bin", F.explode(bins))


def levels_of(df: DataFrame, start: Column, last: Column, bin_size: int = BIN) -> list[int]:
    """The levels that occur, at most one for each three bits of the longest interval."""
    rows = df.filter(last >= start).groupBy(bin_level(start, last, bin_size).alias("level")).count().collect()
    return sorted(r["level"] for r in rows)


def _each(levels: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(x) for x in levels])) if len(levels) > 1 else F.lit(levels[0])


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str] = ("chrom",),
    pos: str = "pos",
    start: str = "start",
    end: str = "end",
    how: str = "inner",
    closed: bool = False,
    bin_size: int = BIN,
) -> DataFrame:
    """Points with the intervals that hold them: ``start <= pos < end`` (``<= end``
    if ``closed``). ``how='left'`` keeps every interval; intervals must then be unique.

    A point probes one bin for each level that occurs. ``bin_size``, a power of two, is
    the width of the narrowest bins.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    low = F.col(start)
    last = F.col(end) if closed else F.col(end) - 1
    levels = levels_of(intervals, low, last, bin_size) or [0]
    spread = interval_bins(intervals.filter(last >= low), low, last, bin_level(low, last, bin_size), bin_size)
    binned = points.withColumn("_level", _each(levels)).withColumn(
        "_bin", bin_at(F.col(pos), F.col("_level"), bin_size)
    )
    inside = (F.col(pos) >= low) & (F.col(pos) <= last)
    matched = spread.join(binned, [*keys, "_level", "_bin"]).filter(inside).drop("_level", "_bin")
    if how == "inner":
        return matched
    return intervals.join(matched, list(intervals.columns), "left")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    keys: Sequence[str] = ("chrom",),
    bin_size: int = BIN,
) -> DataFrame:
    """Pairs of intervals that overlap, both ends inclusive, each pair once.

    ``left`` is read once and never asked for its levels, so it should be the larger side.
    A pair meets on the level of its longer interval, in the bin where the left one starts;
    intervals of ``left`` wider than all levels of ``right`` are kept aside by the same
    pass and joined from what was stored. The result is checkpointed.
    """
    (ls, le), (rs, re_) = left_range, right_range
    levels = levels_of(right, F.col(rs), F.col(re_), bin_size) or [0]
    found = cut_lineage(
        _overlaps_by_start(left, right, left_range, right_range, keys, bin_size, levels, range(levels[-1] + 1), True)
    )
    pairs = found.filter(~F.col("_aside")).drop("_aside")
    aside = found.filter("_aside").select(*left.columns)
    if aside.isEmpty():
        return pairs
    wide = levels_of(aside, F.col(ls), F.col(le), bin_size)
    return pairs.unionByName(
        _overlaps_by_start(aside, right, left_range, right_range, keys, bin_size, levels, wide, False).drop("_aside")
    )


def _overlaps_by_start(left, right, left_range, right_range, keys, bin_size, right_levels, left_levels, set_aside):
    """Overlapping pairs with left intervals of ``left_levels``; with ``set_aside``, also one row
    marked ``_aside`` for each left interval of a wider level."""
    (ls, le), (rs, re_) = left_range, right_range
    if set_aside:
        # All left rows pass here: a comparison for each level that is not set aside.
        own, size = F.lit(-1), F.col(le) - F.col(ls)
        for level in reversed(left_levels):
            own = F.when(size <= F.lit(min(bin_size << (GROWTH_BITS * level), 1 << 63) - 1), level).otherwise(own)
    else:
        own = bin_level(F.col(ls), F.col(le), bin_size)

    def on_levels(df, own_name, others):
        # Without wider levels on the other side a row stays one row.
        wider = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col(own_name))
        if set_aside:
            wider = F.when(F.col(own_name) >= 0, wider).otherwise(F.array().cast("array<int>"))
        spread = F.explode(F.concat(F.array(F.col(own_name)), wider)) if others else F.col(own_name)
        return df.withColumn("_level", spread)

    first = min(left_levels)
    probes = on_levels(
        left.filter(F.col(le) >= F.col(ls)).withColumn("_own_l", own), "_own_l", [x for x in right_levels if x > first]
    ).withColumn("_bin", F.when(F.col("_level") >= 0, bin_at(F.col(ls), F.greatest("_level", F.lit(0)), bin_size)).otherwise(0))
    # A left interval is no wider than a bin, so it starts in a bin of this one or right before.
    bins = F.sequence(bin_at(F.col(rs), F.col("_level"), bin_size) - 1, bin_at(F.col(re_), F.col("_level"), bin_size))
    table = on_levels(
        right.filter(F.col(re_) >= F.col(rs)).withColumn("_own_r", bin_level(F.col(rs), F.col(re_), bin_size)),
        "_own_r",
        [x for x in left_levels if x > right_levels[0]],
    ).withColumn("_bin", F.explode(bins))
    if set_aside:
        marks = right.select(*keys).distinct().withColumns({"_level": F.lit(-1), "_bin": F.lit(0).cast("bigint")})
        table = table.unionByName(marks, allowMissingColumns=True)
    meets = (
        (F.col(ls) <= F.col(re_))
        & (F.col(le) >= F.col(rs))
        & (F.col("_level") == F.greatest("_own_l", "_own_r"))
    )
    aside = F.col("_level") == -1
    return (
        probes.join(table, [*keys, "_level", "_bin"])
        .filter(aside | meets)
        .withColumn("_aside", aside)
        .drop("_level", "_bin", "_own_l", "_own_r")
    )


def overlaps(loc: Column, loc3: Column, start: Column, end: Column) -> Column:
    """Read-overlaps-region predicate; ``loc3`` is one past the read and counts as inside."""
    return (loc <= end) & (loc3 >= start)


def slice_genome(intervals: DataFrame, genome: DataFrame, chunk_size: int = CHUNK) -> DataFrame:
    """``chrom,start,end,seq`` for the distinct 0-based half-open intervals.

    ``genome`` holds ``chrom,chunk_no,offset,seq`` with chunks of ``chunk_size``.
    Intervals on unknown chromosomes give no row; past a chromosome end the text is empty.
    Chunks meet their intervals in a shuffled join: the planner takes text for short.
    """
    wanted = intervals.select("chrom", "start", "end").distinct()
    # One row per chromosome.
    known = wanted.join(F.broadcast(genome.select("chrom").distinct()), "chrom", "left_semi")
    low = F.greatest(F.col("start"), F.lit(0))
    spread = wanted.withColumn(
        "chunk_no",
        F.explode(
            F.sequence(
                _bin(low, chunk_size),
                F.greatest(_bin(F.col("end") - 1, chunk_size), _bin(low, chunk_size)),
            )
        ),
    )
    first = F.greatest(low - F.col("offset"), F.lit(0))
    last = F.least(F.col("end") - F.col("offset"), F.length("seq"))
    pieces = spread.join(genome.hint("merge"), ["chrom", "chunk_no"]).select(
        "chrom",
        "start",
        "end",
        "chunk_no",
        F.substring(
            F.col("seq"),
            (first + 1).cast("int"),
            F.greatest(last - first, F.lit(0)).cast("int"),
        ).alias("piece"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "piece")))
    joined = pieces.groupBy("chrom", "start", "end").agg(
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("seq")
    )
    return known.join(joined, ["chrom", "start", "end"], "left").select(
        "chrom", "start", "end", F.coalesce("seq", F.lit("")).alias("seq")
    )


def genome_lengths(genome: DataFrame) -> DataFrame:
    """``chrom,length`` of a chunked genome."""
    return genome.groupBy("chrom").agg(
        F.max(F.col("offset") + F.length("seq")).alias("length")
    )
