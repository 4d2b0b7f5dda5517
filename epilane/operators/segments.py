"""Genome segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilane.functions.sequence import rev_comp
from epilane.operators.intervals import CHUNK, genome_lengths, slice_genome
from epilane.session import cut_lineage
from epilane.sources.sequences import read_segments


def extract_segments(
    genome: DataFrame, segments: DataFrame, rc: bool = False, chunk_size: int = CHUNK
) -> DataFrame:
    """``chrom,pos,len,seq,past_end`` for a table of 0-based positions and lengths,
    reverse-complemented if asked. An unknown chromosome gives NULL text."""
    wanted = segments.select("chrom", "pos", "len").withColumns(
        {"start": F.col("pos"), "end": F.col("pos") + F.col("len")}
    )
    # Read by three steps: what makes or reads the text runs once.
    genome = cut_lineage(genome)
    text = slice_genome(wanted, genome, chunk_size)
    # One row per chromosome.
    lengths = F.broadcast(genome_lengths(genome))
    seq = rev_comp(F.col("seq")) if rc else F.upper("seq")
    return (
        wanted.join(text, ["chrom", "start", "end"], "left")
        .join(lengths, "chrom", "left")
        .select(
            "chrom", "pos", "len", seq.alias("seq"), (F.col("end") >= F.col("length")).alias("past_end")
        )
    )


def extract_indexed(index: DataFrame, segments: DataFrame, rc: bool = False) -> DataFrame:
    """``extract_segments`` from FASTA files by their index: only the bytes of the segments
    are read. An unknown chromosome gives NULL text and ``past_end``."""
    wanted = segments.select("chrom", "pos", "len").withColumns(
        {"start": F.col("pos"), "end": F.col("pos") + F.col("len")}
    )
    text = read_segments(index, wanted).drop("bytes_read")
    seq = rev_comp(F.col("seq")) if rc else F.upper("seq")
    return wanted.join(text, ["chrom", "start", "end"], "left").select(
        "chrom", "pos", "len", seq.alias("seq"), (F.col("end") >= F.col("length")).alias("past_end")
    )
