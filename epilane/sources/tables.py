"""Counts, intervals, region tables, expression tables and small lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilane.functions.sam import sample_names
from epilane.operators.ordered import running
from epilane.sources.lines import line_tile, numbered_lines, required_fields

TAB = "\t"

def _count_rows(spark: SparkSession, paths) -> DataFrame:
    """Six tab fields per line; any other number fails."""
    lines = numbered_lines(spark, paths).filter(F.col("line") != "")
    fields = required_fields(F.col("line"), 6, "counts record", exact=True)
    return lines.withColumn("f", fields).select(
        "file",
        F.get("f", F.lit(0)).alias("chrom"),
        F.get("f", F.lit(1)).cast("bigint").alias("pos"),
        F.get("f", F.lit(4)).cast("bigint").alias("meth"),
        F.get("f", F.lit(5)).cast("bigint").alias("unmeth"),
    )


def read_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``sample,chrom,pos,meth,unmeth`` of one counts file (or folder of parts) per
    sample. Paths with distinct last steps are one scan."""
    if isinstance(paths, str):
        paths = [paths]
    names = sample_names(paths)
    bases = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    if len(set(bases)) == len(bases):
        steps = F.split("file", "/")
        known = F.create_map(*[F.lit(v) for pair in zip(bases, names) for v in pair])
        sample = F.coalesce(
            F.try_element_at(known, F.element_at(steps, -1)),
            F.try_element_at(known, F.element_at(steps, -2)),
        )
        table = _count_rows(spark, paths).withColumn("sample", sample)
    else:
        table = reduce(
            DataFrame.unionByName,
            [_count_rows(spark, p).withColumn("sample", F.lit(n)) for p, n in zip(paths, names)],
        )
    return table.select("sample", "chrom", "pos", "meth", "unmeth")


def read_bed(spark: SparkSession, path, mode: str = "named") -> DataFrame:
    """``chrom,start,end,name``.

    ``named`` needs four fields and unique names, ``three`` exactly three fields (named
    by place). ``numbered`` numbers the lines of three fields from 0, keeps the first of
    equal names and skips shorter lines.
    """
    lines = numbered_lines(spark, path).filter(F.col("line") != "")
    if mode == "named":
        fields = required_fields(F.col("line"), 4, "BED record")
    elif mode == "three":
        fields = required_fields(F.col("line"), 3, "BED record", exact=True)
    elif mode == "numbered":
        fields = F.split("line", TAB)
        lines = lines.filter(F.size(fields) >= 3)
    else:
        raise ValueError("mode must be 'named', 'three' or 'numbered'")

    def at(i):
        return F.get("f", F.lit(i))

    rows = lines.withColumn("f", fields).select(
        "file",
        "line_no",
        at(0).alias("chrom"),
        at(1).cast("bigint").alias("start"),
        at(2).cast("bigint").alias("end"),
        at(3).alias("name"),
    )
    columns = ["chrom", "start", "end", "name"]
    if mode == "three":
        place = F.concat(
            "chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")
        )
        return rows.withColumn("name", place).select(*columns)
    firsts = rows.filter(F.col("name").isNotNull()).groupBy("name").agg(
        F.min(F.struct("line_no", "chrom", "start", "end")).alias("r"), F.count(F.lit(1)).alias("n")
    )
    if mode == "named":
        repeated = F.raise_error(F.concat(F.lit("repeated BED region name: "), F.col("name")))
        chrom = F.when(F.col("n") > 1, repeated.cast("string")).otherwise(F.col("r.chrom"))
        return firsts.select(chrom.alias("chrom"), "r.start", "r.end", "name")
    counted = running(
        rows.filter(F.col("name").isNull()),
        ["file"],
        ["line_no"],
        {"seen": ("sum", F.lit(1))},
        line_tile(),
    ).withColumn("name", (F.col("seen") - 1).cast("string"))
    return firsts.select("r.chrom", "r.start", "r.end", "name").unionByName(counted.select(*columns))


def _header(spark: SparkSession, path, skip: int = 0) -> list[str]:
    first = spark.read.text(path).limit(skip + 1).collect()
    return first[skip]["value"].rstrip("\r\n").split("\t")


def read_regions(spark: SparkSession, path, groups: dict[str, list[str]] | list[str], keep: list[str] | None = None) -> DataFrame:
    """Long region table ``chrom,start,end,cpg[,keep],sample,n,x``.

    Sample columns are found by name in the header, as ``s-N`` and ``s-X`` or as one
    fraction ``s`` (then ``n`` is 1 and ``x`` the fraction); a missing sample fails.
    """
    header = _header(spark, path)
    if header[0] != "chr":
        raise ValueError("not a region table: its first column must be chr")
    samples = groups if isinstance(groups, list) else [s for g in groups.values() for s in g]
    keep = keep or []
    missing = [c for c in keep if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    table = spark.read.csv(path, sep="\t", header=True, nullValue="NA")

    def value(column, kind):
        return F.col(f"`{column}`").cast(kind)

    cells = []
    for s in samples:
        if f"{s}-N" in header and f"{s}-X" in header:
            cells.append((s, value(f"{s}-N", "bigint"), value(f"{s}-X", "bigint")))
        elif s in header:
            cells.append((s, F.when(F.col(f"`{s}`").isNotNull(), F.lit(1.0)), value(s, "double")))
        else:
            raise ValueError(f"no column for sample {s} in the region table")
    rows = F.array(
        *[F.struct(F.lit(s).alias("sample"), n.alias("n"), x.alias("x")) for s, n, x in cells]
    )
    return table.select(
        F.col("chr").alias("chrom"),
        value("start", "bigint").alias("start"),
        value("end", "bigint").alias("end"),
        value("CpG", "bigint").alias("cpg"),
        *[F.col(f"`{c}`") for c in keep],
        F.inline(rows),
    ).filter(F.col("n").isNotNull())


def read_feature_counts(spark: SparkSession, path) -> DataFrame:
    """Gene count table: leading comment line dropped, columns named by the header."""
    return spark.read.csv(path, sep="\t", header=True, comment="#")


# The columns a comparison table must have at these places.
DIFF_COLUMNS = {
    4: "sample_1",
    5: "sample_2",
    6: "status",
    9: "log2(fold_change)",
    13: "significant",
}


def read_gene_diff(spark: SparkSession, path) -> DataFrame:
    """``gene,sample_1,sample_2,status,fold,significant`` of a comparison table."""
    header = _header(spark, path)
    for place, name in DIFF_COLUMNS.items():
        if len(header) <= place or header[place] != name:
            raise ValueError("not a table of gene comparisons")
    table = spark.read.csv(path, sep="\t", header=True)
    fold = F.col("`log2(fold_change)`")
    return table.select(
        F.col(f"`{header[0]}`").alias("gene"),
        "sample_1",
        "sample_2",
        "status",
        F.when(fold == "inf", F.lit(float("inf")))
        .when(fold == "-inf", F.lit(float("-inf")))
        .otherwise(fold.try_cast("double"))
        .alias("fold"),
        "significant",
    )


def read_names(spark: SparkSession, path) -> DataFrame:
    """``qname``: first tab field of each line."""
    return numbered_lines(spark, path).select(F.substring_index("line", "\t", 1).alias("qname"))


def read_chrom_order(spark: SparkSession, path) -> DataFrame:
    """``ord,chrom`` of lines holding comma-separated names."""
    return numbered_lines(spark, path).filter(F.col("line") != "").select(
        "line_no", F.posexplode(F.split("line", ",")).alias("place", "chrom")
    ).select(F.struct("line_no", "place").alias("ord"), "chrom")


def read_dmrs(spark: SparkSession, path, keys: int = 4) -> DataFrame:
    """Region test table: ``chrom,start,end,cpg``, then its statistics as doubles; the
    header names them and may stand in several files."""
    lines = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").option("quote", "")
    table = lines.csv(path)
    names = ["chrom", "start", "end", "cpg"][:keys]
    kinds = ["string", "bigint", "bigint", "bigint"][:keys]
    kept = [F.col(f"`{c}`").cast(k).alias(n) for c, n, k in zip(table.columns, names, kinds)]
    return table.select(*kept, *[F.col(f"`{c}`").cast("double").alias(c) for c in table.columns[keys:]])
