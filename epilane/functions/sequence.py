"""Base, quality and methylation strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The five bases and their complements, and the call letters of
# non-CpG contexts.
BASES, COMPLEMENTS = "ACGTN", "TGCAN"
NON_CPG_CALLS = "hHxX"
PHRED_OFFSET = 33


def rev_comp(seq: Column, unknown: str = "fail") -> Column:
    """Reverse complement. ``unknown='fail'`` upper-cases first and rejects other
    letters; ``unknown='drop'`` keeps only upper-case ACGTN."""
    if unknown == "drop":
        known = F.regexp_replace(seq, "[^ACGTN]", "")
        return F.translate(F.reverse(known), BASES, COMPLEMENTS)
    if unknown != "fail":
        raise ValueError(f"unknown must be 'fail' or 'drop', not {unknown!r}")
    upper = F.upper(seq)
    return F.when(
        upper.rlike("[^ACGTN]"),
        F.raise_error(F.lit("unknown nucleotide in sequence")).cast("string"),
    ).otherwise(F.translate(F.reverse(upper), BASES, COMPLEMENTS))


def rev_qual(qual: Column) -> Column:
    """Quality string of the reversed read."""
    return F.reverse(qual)


def _byte_sums(texts):
    """Sum of the bytes of each text less the offset, over the batch's one buffer."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    marks = np.zeros(1 if data is None else data.size + 1, np.int64)
    if data is not None:
        np.cumsum(np.frombuffer(data, np.uint8), out=marks[1:])
    sums = np.diff(marks[ends]) - PHRED_OFFSET * np.diff(ends)
    return pa.array(sums, pa.int64(), mask=np.asarray(texts.is_null()))


def phred_sum(qual: Column) -> Column:
    """Sum of Phred scores (bigint). Plain text is summed by batches."""

    @F.arrow_udf("long")
    def summed(texts: pa.Array) -> pa.Array:
        return _byte_sums(texts)

    return F.when(qual.rlike(r"[^\x00-\x7F]"), _phred_sum_by_letter(qual)).otherwise(summed(qual))


def _phred_sum_by_letter(qual: Column) -> Column:
    return F.aggregate(
        F.split(qual, ""),
        F.lit(0).cast("bigint"),
        lambda acc, c: acc + F.when(c == "", F.lit(0)).otherwise(F.ascii(c) - PHRED_OFFSET),
    )


def cpg_count(seq: Column) -> Column:
    """Number of CG dinucleotides, any case."""
    upper = F.upper(seq)
    return ((F.length(upper) - F.length(F.replace(upper, F.lit("CG"), F.lit("")))) / 2).cast("int")


def mask_context(calls: Column) -> Column:
    """Methylation string with non-CpG calls blanked to dots."""
    return F.translate(calls, NON_CPG_CALLS, "." * len(NON_CPG_CALLS))


def meth_frac(meth: Column, unmeth: Column) -> Column:
    """Methylated fraction; NULL without counts."""
    return F.try_divide(meth.cast("double"), (meth + unmeth).cast("double"))
