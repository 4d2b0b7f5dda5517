"""Text writers. Numbers stay numbers until here."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from epilane.functions import sam as s
from epilane.session import dropping_shuffles

TAB = "\t"


@F.pandas_udf(StringType())
def fixed6(values: pd.Series) -> pd.Series:
    """Six decimals of the exact binary value, ties to even; Spark's own format rounds
    the shortest decimal half up."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:.6f}")


def _codec(path: str) -> str:
    return "gzip" if str(path).endswith(".gz") else "none"


def _write_text(lines: DataFrame, path: str) -> None:
    with dropping_shuffles(lines.sparkSession):
        lines.write.option("compression", _codec(path)).text(path)


def _write_table(df: DataFrame, path: str, header: bool = False, **options) -> None:
    with dropping_shuffles(df.sparkSession):
        df.write.options(sep=TAB, header=header, compression=_codec(path), quote="", **options).csv(path)


def write_bed(df: DataFrame, path: str) -> None:
    """``chrom,start,end,qname`` lines."""
    _write_table(df.select("chrom", "start", "end", "qname"), path)


def write_counts(df: DataFrame, path: str, layout: str = "end-pct") -> None:
    """Counts file. ``layout`` names fields three and four: ``end-pct``, ``strand-pct``
    or ``end-strand``."""
    end, strand, pct = (F.col("pos") + 1).cast("string"), F.lit("+"), fixed6(F.col("pct"))
    middle = {
        "end-pct": (end, pct),
        "strand-pct": (strand, pct),
        "end-strand": (end, strand),
    }[layout]
    _write_table(
        df.select("chrom", "pos", middle[0].alias("c3"), middle[1].alias("c4"), "meth", "unmeth"), path
    )


def write_regions(wide: DataFrame, path: str) -> None:
    """Region table with header ``chr,start,end,CpG,<samples>`` and ``NA`` cells."""
    keys = {"chrom": "chr", "start": "start", "end": "end", "cpg": "CpG"}
    kinds = dict(wide.dtypes)
    cells = [
        (fixed6(F.col(f"`{c}`")) if kinds[c] == "double" else F.col(f"`{c}`")).alias(c)
        for c in wide.columns
        if c not in keys
    ]
    table = wide.select(*[F.col(k).alias(v) for k, v in keys.items()], *cells)
    _write_table(table, path, header=True, nullValue="NA", emptyValue="NA")


def write_fastq(df: DataFrame, path: str) -> None:
    """Four-line records; with an ``end`` column one folder per end, mates at the same
    place of files of the same number. They are ordered by ``pair``, or by their common
    name where that column is missing."""
    record = F.concat(
        F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual"
    ).alias("value")
    if "end" in df.columns:
        # Ranges of pairs become files; within a file the order stays that of the pairs,
        # because it starts with the column that the writer would sort by.
        pair = F.col("pair") if "pair" in df.columns else F.regexp_replace("name", " /[12]$", "")
        keyed = df.select("end", record, pair.alias("pair"))
        ordered = keyed.repartitionByRange("pair").sortWithinPartitions("end", "pair")
        with dropping_shuffles(df.sparkSession):
            ordered.select("end", "value").write.partitionBy("end").option(
                "compression", _codec(path)
            ).text(path)
    else:
        _write_text(df.select(record), path)


def write_fasta(genome: DataFrame, path: str, width: int = 60) -> None:
    """Chunks of a genome (``chrom,offset,seq``) as FASTA lines of ``width`` bases.

    Files hold ranges of (chromosome, offset), so a long chromosome is written by many
    tasks. A file that begins within one starts with a header that names the offset (read
    it with ``pieces``); offsets must be multiples of ``width``.
    """
    ordered = genome.select("chrom", "offset", "seq").repartitionByRange("chrom", "offset")
    rows = ordered.sortWithinPartitions("chrom", "offset").withColumn(
        "first", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    )
    uneven = F.raise_error(F.lit("offsets must be multiples of the line width")).cast("string")
    head = F.when(F.col("offset") % width != 0, uneven).when(
        F.col("offset") == 0, F.concat(F.lit(">"), "chrom")
    ).when(F.col("first"), F.concat(F.lit(">"), "chrom", F.lit(" offset="), F.col("offset").cast("string")))
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    _write_text(rows.select(F.concat_ws("\n", head, body).alias("value")), path)


def write_linked(linked: DataFrame, sites: DataFrame, path: str) -> None:
    """Report per region: heading, site list, one pattern line per read."""
    listed = sites.groupBy("name").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ", "
        ).alias("listing")
    )
    regions = linked.select("name", "chrom", "start", "end").distinct().join(listed, "name", "left")
    heading = F.concat(
        F.lit("Region: "), "name", F.lit(", "), "chrom", F.lit(":"), F.col("start").cast("string"),
        F.lit("-"), F.col("end").cast("string"), F.lit("\nSites: "),
        F.coalesce("listing", F.lit("<none>")),
    )
    closing = regions.select("name", F.lit(2).alias("part"), F.lit("").alias("qname"), F.lit("").alias("value"))
    heads = regions.select("name", F.lit(0).alias("part"), F.lit("").alias("qname"), heading.alias("value"))
    reads = linked.filter(F.col("qname").isNotNull()).select(
        "name", F.lit(1).alias("part"), "qname", F.concat_ws(TAB, "pattern", "qname").alias("value")
    )
    ordered = heads.unionByName(reads).unionByName(closing).orderBy("name", "part", "qname")
    _write_text(ordered.select("value"), path)


def write_dups(df: DataFrame, path: str) -> None:
    """``qname, aln:..., parent, type`` lines."""
    _write_table(df.select("qname", "aln", "parent", "type"), path)


def sam_lines(df: DataFrame) -> DataFrame:
    """``line_no,value``: records as text."""
    fields = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    return df.select(
        "line_no", F.concat_ws(TAB, *[F.col(c).cast("string") for c in fields], F.col("tags")).alias("value")
    )


def write_sam(df: DataFrame, header: DataFrame | None, path: str) -> None:
    """Header lines, then the records in their original order."""
    rows = sam_lines(df).withColumn("part", F.lit(1))
    if header is not None:
        rows = rows.unionByName(
            header.select("line_no", F.col("line").alias("value"), F.lit(0).alias("part"))
        )
    _write_text(rows.orderBy("part", "line_no").select("value"), path)


def write_chrom_order(chroms: DataFrame, path: str) -> None:
    """One chromosome name per line, in header order."""
    _write_text(chroms.orderBy("ord").select("chrom"), path)


def write_dmrs(wide: DataFrame, path: str) -> None:
    """Region test table; statistics rounded to seven digits."""
    keys = {"chrom": "chr", "start": "start", "end": "end", "cpg": "CpG"}
    cells = [F.round(F.col(f"`{c}`"), 7).alias(c) for c in wide.columns if c not in keys]
    table = wide.select(*[F.col(k).alias(v) for k, v in keys.items()], *cells)
    _write_table(table, path, header=True, nullValue="NA", emptyValue="NA")


def write_matrix(wide: DataFrame, path: str) -> None:
    """Table under a header, as it is; ``NA`` cells. For gene counts, fold changes, quality
    tables and site summaries."""
    _write_table(wide, path, header=True, nullValue="NA", emptyValue="NA")


def write_pileup(rows: DataFrame, path: str) -> None:
    """Padded lines by region and position, the genome first."""
    line = F.concat(F.repeat(F.lit(" "), F.col("pad").cast("int")), "text")
    _write_text(rows.orderBy("name", F.col("line_no").isNotNull(), "pos", "line_no").select(line.alias("value")), path)


def run_summary(sam: DataFrame, summary: DataFrame) -> DataFrame:
    """``item,value`` rows of a run: all records, those not primary, and each figure of
    the one-row call summary."""
    records = sam.agg(
        F.count(F.lit(1)).cast("double").alias("records"),
        F.count_if(s.flag(F.col("flag"), s.NOT_PRIMARY)).cast("double").alias("not_primary"),
    )

    def listed(df):
        return df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value"))
                        for c in df.columns
                    ]
                )
            ).alias("r")
        ).select("r.*")

    return listed(records).unionByName(listed(summary))
