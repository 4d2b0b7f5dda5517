"""Base quality by methylation context and by base.

Letters and qualities of a batch of reads are counted at once, per (letter, score), and
each task gives its counts as a few hundred rows, however many reads there are: no row per
base is made.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilane.functions.sam import tag
from epilane.functions.sequence import PHRED_OFFSET

# Call letters and bases, in report order.
CONTEXTS = ["h", "H", "x", "X", "z", "Z"]
BASES = ["A", "C", "G", "T", "N"]
# Stands for the quality of a letter beyond the end of its quality string.
NO_QUALITY = chr(0x10FFFF)
ROWS = 4096


def _count(letters: list[str], quals: list[str], counts: Counter) -> None:
    """Add the pairs of letter and quality code of some reads."""
    joined = [
        np.frombuffer("".join(side).encode("utf-32-le"), "<u4")
        for side in (letters, [q[: len(x)].ljust(len(x), NO_QUALITY) for x, q in zip(letters, quals, strict=True)])
    ]
    if not len(joined[0]):
        return
    if max(x.max() for x in joined) < 256:
        cells = np.bincount(joined[0] * 256 + joined[1], minlength=1)
        at = np.flatnonzero(cells)
        found = zip((at // 256).tolist(), (at % 256).tolist(), cells[at].tolist(), strict=True)
    else:
        pairs, n = np.unique(joined[0].astype(np.int64) << 32 | joined[1], return_counts=True)
        found = zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), n.tolist(), strict=True)
    for letter, qual, n in found:
        counts[letter, qual] += n


def _histogram(df: DataFrame, letters: str, quals: str) -> DataFrame:
    """``letter,score,n`` over all reads; the score is NULL where a read has no quality for
    a letter. Reads without letters or without a quality string count nothing."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                pairs = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                held = [(a, b) for a, b in pairs if a is not None and b is not None]
                _count([a for a, _ in held], [b for _, b in held], counts)
        none = ord(NO_QUALITY)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chr(c) for c, _ in counts], pa.string()),
                pa.array([None if q == none else q - PHRED_OFFSET for _, q in counts], pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            names=["letter", "score", "n"],
        )

    found = df.select(F.col(letters), F.col(quals)).mapInArrow(run, "letter string, score int, n long")
    return found.groupBy("letter", "score").agg(F.sum("n").alias("n"))


def context_quality(sam: DataFrame, min_qual: int = 30) -> DataFrame:
    """``context,bad,good,bad_frac`` of the calls below and from ``min_qual``; the
    fraction is NULL without calls."""
    reads = sam.select(tag(F.col("tags"), "XM").alias("xm"), "qual")
    counted = (
        _histogram(reads, "xm", "qual")
        .filter(F.col("letter").isin(*CONTEXTS))
        .groupBy("letter")
        .agg(
            F.sum(F.when(F.col("score") < min_qual, F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("score") >= min_qual, F.col("n")).otherwise(0)).alias("good"),
        )
    )
    contexts = F.explode(F.array(*[F.lit(c) for c in CONTEXTS])).alias("context")
    listed = sam.sparkSession.range(1).select(contexts)
    return listed.join(counted, F.col("context") == F.col("letter"), "left").select(
        "context",
        F.coalesce("bad", F.lit(0)).alias("bad"),
        F.coalesce("good", F.lit(0)).alias("good"),
        F.try_divide(F.col("bad").cast("double"), (F.col("bad") + F.col("good")).cast("double")).alias(
            "bad_frac"
        ),
    )


def base_quality(fastq: DataFrame) -> DataFrame:
    """``base,mean,std,n``: mean, population deviation and count of scores per base.
    Other letters fail."""
    unknown = F.concat(F.lit("unknown base "), F.col("letter"))
    known = _histogram(fastq, "seq", "qual").withColumn(
        "letter",
        F.when(F.col("letter").isin(*BASES), F.col("letter")).otherwise(
            F.raise_error(unknown).cast("string")
        ),
    )
    # A base has as many rows here as there are scores.
    scored = F.filter(F.collect_list(F.struct("score", "n")), lambda r: r["score"].isNotNull())
    listed = known.groupBy(F.col("letter").alias("base")).agg(
        scored.alias("scores"), F.sum("n").alias("n")
    )

    def total(term):
        return F.aggregate("scores", F.lit(0.0), lambda s, r: s + term(r))

    held = listed.withColumn("k", total(lambda r: r["n"].cast("double"))).withColumn(
        "mean", F.try_divide(total(lambda r: r["score"] * r["n"].cast("double")), "k")
    )
    spread = total(lambda r: (r["score"] - F.col("mean")) * (r["score"] - F.col("mean")) * r["n"])
    return held.select("base", "mean", F.sqrt(F.try_divide(spread, "k")).alias("std"), "n")
