"""CIGAR columns: run-length operations as arrays, offsets and expansions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the alignment format: operations that advance along the
# reference (soft clips counted, as duplicate keys need them) and those that do not.
REF_ADVANCING = ["M", "D", "N", "S", "=", "X"]
REF_NEUTRAL = ["I", "P", "H"]
RUN_PATTERN = r"(\d+)(\D)"


def cigar_ops(cigar: Column) -> Column:
    """``array<struct<len,op>>`` of the runs in a CIGAR; empty for ``*``."""
    return F.zip_with(
        F.regexp_extract_all(cigar, F.lit(RUN_PATTERN), F.lit(1)),
        F.regexp_extract_all(cigar, F.lit(RUN_PATTERN), F.lit(2)),
        lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")),
    )


def _total(cigar: Column, op: str) -> Column:
    runs = F.regexp_extract_all(cigar, F.lit(rf"(\d+){op}"), F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda acc, n: acc + n.cast("int"))


def cigar_indel(cigar: Column) -> Column:
    """Deleted minus inserted bases (int)."""
    deleted, inserted = (
        F.when(F.contains(cigar, F.lit(op)), _total(cigar, op)).otherwise(F.lit(0)) for op in "DI"
    )
    return deleted - inserted


def cigar_expand(cigar: Column) -> Column:
    """One character per M, I or D base; other operations are left out."""
    kept = F.filter(cigar_ops(cigar), lambda r: r["op"].isin("M", "I", "D"))
    return F.array_join(F.transform(kept, lambda r: F.repeat(r["op"], r["len"])), "")


def _advance(run: Column) -> Column:
    return (
        F.when(run["op"].isin(*REF_ADVANCING), run["len"])
        .when(run["op"].isin(*REF_NEUTRAL), F.lit(0))
        .otherwise(
            F.raise_error(F.concat(F.lit("unknown CIGAR operation "), run["op"])).cast("int")
        )
    )


def cigar_ref_len(cigar: Column) -> Column:
    """Distance from the recorded position to the 3' end; unknown operations fail."""
    known = "".join(REF_ADVANCING)
    unknown = rf"\d([^\d{known}{''.join(REF_NEUTRAL)}])"
    alone = F.regexp_extract(cigar, r"^(\d+)M\z", 1)
    problem = F.concat(F.lit("unknown CIGAR operation "), F.regexp_extract(cigar, unknown, 1))
    return (
        F.when(alone != "", alone.cast("int"))
        .when(cigar.rlike(unknown), F.raise_error(problem).cast("int"))
        .otherwise(_total(cigar, f"[{known}]"))
    )


def cigar_clip(cigar: Column) -> Column:
    """Shift of the true start: leading soft clip backwards, leading deletion forwards."""
    op, size = (F.regexp_extract(cigar, RUN_PATTERN, k) for k in (2, 1))
    return (
        F.when(op == "S", -size.cast("int"))
        .when(op == "D", size.cast("int"))
        .otherwise(F.lit(0))
    )


def cigar_splices(cigar: Column, reverse: Column) -> Column:
    """``offset-length`` of every N run, measured from the 5' side of the strand."""
    ops = cigar_ops(cigar)
    ordered = F.when(reverse, F.reverse(ops)).otherwise(ops)
    start = F.struct(
        F.lit(0).alias("off"), F.array().cast("array<string>").alias("found")
    )

    def step(acc, run):
        here = F.concat_ws("-", acc["off"].cast("string"), run["len"].cast("string"))
        return F.struct(
            (acc["off"] + _advance(run)).alias("off"),
            F.when(run["op"] == "N", F.concat(acc["found"], F.array(here)))
            .otherwise(acc["found"])
            .alias("found"),
        )

    return F.when(
        F.contains(cigar, F.lit("N")), F.aggregate(ordered, start, step, lambda a: a["found"])
    ).otherwise(F.array().cast("array<string>"))


def gap_string(seq: Column, cigar: Column) -> Column:
    """Read string on the reference axis: a dash for every deleted base."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))

    def step(acc, run):
        deleted = run["op"] == "D"
        return F.struct(
            F.when(deleted, acc["at"]).otherwise(acc["at"] + run["len"]).alias("at"),
            F.concat(
                acc["text"],
                F.when(deleted, F.repeat(F.lit("-"), run["len"])).otherwise(
                    F.substring(seq, acc["at"], run["len"])
                ),
            ).alias("text"),
        )

    kept = F.filter(cigar_ops(cigar), lambda r: r["op"].isin("M", "I", "D"))
    return F.when(
        F.contains(cigar, F.lit("D")), F.aggregate(kept, start, step, lambda a: a["text"])
    ).otherwise(F.substring(seq, F.lit(1), _total(cigar, "M") + _total(cigar, "I")))
