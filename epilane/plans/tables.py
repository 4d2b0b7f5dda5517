"""Sequencing-shaped tables derived from the benchmark tables.

Each view is one SQL text that Spark and the checking engine run alike; only the
table names are filled in. The views read their base tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = """
select concat('chr', cast(1 + l_partkey % 5 as varchar(9))) as chrom,
       l_partkey * 13 + (l_partkey * l_partkey) % 211 + 1 as pos,
       concat(l_returnflag, l_linestatus) as sample,
       cast(sum(cast(l_quantity as bigint)) as bigint) as meth,
       cast(sum(cast(l_linenumber * 6 as bigint)) as bigint) as unmeth
from {lineitem} group by 1, 2, 3
"""

BED = """
select distinct concat('chr', cast(1 + p_partkey % 5 as varchar(9))) as chrom,
       p_partkey * 13 as start, cast(p_partkey * 13 + 10 * p_size as bigint) as end_,
       concat('reg', cast(p_partkey as varchar(9))) as name
from {part}
"""

WINDOWS = """
select concat('chr', cast(1 + s_suppkey % 5 as varchar(9))) as chrom,
       s_suppkey * 2800 + (s_suppkey * 37) % 60 + 1 as start,
       s_suppkey * 2800 + (s_suppkey * 37) % 60 + 6 + s_suppkey % 40 as end_,
       concat('win', cast(s_suppkey as varchar(9))) as name
from {supplier}
"""

# Long enough chunks that the reads' axis lies within the genome at every scale.
GENOME_CHUNK = 768
_GENOME_TEXT = ", ".join(
    f"md5(concat('g{i}-', cast(p_partkey as varchar(20))))" for i in range(GENOME_CHUNK // 32)
)
GENOME = f"""
select concat('chr', cast(1 + p_partkey % 5 as varchar(9))) as chrom,
       cast(floor(p_partkey / 5) as bigint) as chunk_no,
       cast(floor(p_partkey / 5) as bigint) * {GENOME_CHUNK} as offset_,
       translate(concat({_GENOME_TEXT}), '0123456789abcdef', 'ACGTACGTACGTacgt') as seq
from {{part}}
"""

# Positions grow with the tables at constant depth. Twenty orders share a place, so that a
# few reads of a chromosome are copies; the windows lie where reads are.
ALIGNMENTS = """
with t as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey,
              l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) rn,
         count(*) over (partition by l_orderkey) n,
         concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) k,
         1 + cast(floor(l_orderkey / 20) as bigint) * 400 as base
  from {lineitem})
select cast(l_orderkey * 100000 + rn as bigint) as line_no,
  concat('r', cast(l_orderkey as varchar(20))) as qname,
  cast(case when l_orderkey % 3 = 0 then case when l_orderkey % 2 = 0 then 16 else 0 end
                                  + case when rn > 1 then 256 else 0 end
       when n = 1 then 73 when rn = 1 then 99 when rn = 2 then 147 else 256 + 73 end as int) as flag,
  concat('chr', cast(1 + l_orderkey % 5 as varchar(9))) as rname,
  cast(base + case when rn = 2 then 40 + l_orderkey % 7 else 5 * (rn - 1) end as bigint) as pos,
  case l_orderkey % 4 when 1 then '16M2I14M' when 2 then '10M3D22M' else '32M' end as cigar,
  case when l_orderkey % 3 <> 0 and n > 1 and rn <= 2 then '=' else '*' end as rnext,
  cast(case when l_orderkey % 3 = 0 or n = 1 or rn > 2 then 0
            when rn = 1 then base + 40 + l_orderkey % 7 else base end as bigint) as pnext,
  translate(md5(concat('s', k)), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq,
  translate(md5(concat('q', k)), '0123456789abcdef', '!#%&(+-/159=@CFI') as qual,
  translate(md5(concat('m', k)), '0123456789abcdef', 'zZhHxX..........') as xm,
  case when l_orderkey % 2 = 0 then 'CT' else 'GA' end as xg
from t
"""

# Read pairs with several hits: numbered by HI for even orders, by coordinates alone for
# odd ones (where two hits share them); soft clips on either side, and splices.
HITS = """
with t as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey,
              l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) rn,
         concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) k
  from {lineitem}),
s as (
  select t.*, seg, 1 + cast(floor(l_orderkey / 20) as bigint) * 400
           + 7 * cast(floor(rn / 2) as bigint) as base
  from t join (select 0 as seg union all select 1) x on x.seg >= 0)
select cast(l_orderkey * 100000 + rn * 2 + seg as bigint) as line_no,
  concat('h', cast(l_orderkey as varchar(20))) as qname,
  cast(case when seg = 0 then 99 else 147 end + case when rn > 1 then 256 else 0 end as int) as flag,
  concat('chr', cast(1 + l_orderkey % 5 as varchar(9))) as rname,
  cast(base + 200 * seg as bigint) as pos,
  case (cast(floor(l_orderkey / 10) as bigint) + seg) % 4 when 0 then '32M' when 1 then '5S27M' when 2 then '27M5S'
    else '10M100N22M' end as cigar,
  '=' as rnext,
  cast(base + 200 * (1 - seg) as bigint) as pnext,
  translate(md5(concat('s', k)), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq,
  translate(md5(concat('q', k)), '0123456789abcdef', '!#%&(+-/159=@CFI') as qual,
  case when l_orderkey % 2 = 0 then concat('HI:i:', cast(rn as varchar(9))) end as hi
from s
"""

GENE_DIFF = """
select p_brand as gene, concat('s', cast(l_linenumber as varchar(9))) as sample_1,
       concat('s', cast(l_linenumber + 1 + l_suppkey % 3 as varchar(9))) as sample_2,
       case when max(l_quantity) > 49 then 'OK' else 'NOTEST' end as status,
       case when sum(l_linenumber) % 7 = 0 then cast('inf' as double)
            when sum(l_linenumber) % 11 = 0 then cast('-inf' as double)
            else round(cast(sum(cast(l_quantity as bigint)) % 1000 - 500 as double) / 100, 2) end as fold,
       case when sum(cast(l_quantity as bigint)) % 13 = 0 then 'yes' else 'no' end as significant
from {lineitem} join {part} on l_partkey = p_partkey
group by p_brand, l_linenumber, l_suppkey % 3
"""

# Column names that are reserved words in one of the engines.
RENAMES = {"end_": "end", "offset_": "offset"}

BASE_TABLES = {
    COUNTS: ["lineitem"],
    BED: ["part"],
    WINDOWS: ["supplier"],
    GENOME: ["part"],
    ALIGNMENTS: ["lineitem"],
    HITS: ["lineitem"],
    GENE_DIFF: ["lineitem", "part"],
}


# Views that make much text out of each row of a table that is read in a few splits.
SPREAD = {GENOME: "p_partkey"}


def derive(spark: SparkSession, folder: str, view: str) -> DataFrame:
    """Run a view on the parquet tables in ``folder``."""
    tables = {
        name: spark.read.parquet(f"{folder}/{name}.parquet") for name in BASE_TABLES[view]
    }
    if view in SPREAD:
        tasks = 4 * spark.sparkContext.defaultParallelism
        tables = {name: df.select(SPREAD[view]).repartition(tasks) for name, df in tables.items()}
    df = spark.sql(view, **tables)
    for old, new in RENAMES.items():
        df = df.withColumnRenamed(old, new)
    return df


def oracle_text(view: str) -> str:
    """The view as plain SQL on the registered table names."""
    return view.format(**{name: name for name in BASE_TABLES[view]}).strip()


def counts(spark, folder):
    return derive(spark, folder, COUNTS)


def bed(spark, folder):
    return derive(spark, folder, BED)


def windows(spark, folder):
    return derive(spark, folder, WINDOWS)


def genome(spark, folder):
    return derive(spark, folder, GENOME)


def gene_diff(spark, folder):
    return derive(spark, folder, GENE_DIFF)


def alignments(spark, folder):
    """Alignment records as the reader delivers them, with XM and XG tags."""
    return derive(spark, folder, ALIGNMENTS).select(
        "line_no",
        "qname",
        "flag",
        "rname",
        "pos",
        F.lit(42).alias("mapq"),
        "cigar",
        "rnext",
        "pnext",
        F.lit(0).alias("tlen"),
        "seq",
        "qual",
        F.array(
            F.concat(F.lit("XM:Z:"), "xm"), F.concat(F.lit("XG:Z:"), "xg")
        ).alias("tags"),
    )


def hits(spark, folder):
    """Alignment records of read pairs with several hits each."""
    return derive(spark, folder, HITS).select(
        "line_no",
        "qname",
        "flag",
        "rname",
        "pos",
        F.lit(42).alias("mapq"),
        "cigar",
        "rnext",
        "pnext",
        F.lit(0).alias("tlen"),
        "seq",
        "qual",
        F.when(F.col("hi").isNotNull(), F.array("hi"))
        .otherwise(F.array().cast("array<string>"))
        .alias("tags"),
    )


# Whole texts that about half the reads of a place share.
COPIED_SEQ = (
    "translate(md5(concat('s', cast(cast(floor(line_no / 100000) as bigint) % 2 as varchar(9)))),"
    " '0123456789abcdef', 'ACGTACGTACGTACGT')"
)
COPIED_XM = (
    "translate(md5(concat('m', cast(cast(floor(line_no / 100000) as bigint) % 3 as varchar(9)))),"
    " '0123456789abcdef', 'zZhHxX..........')"
)


def copied_alignments(spark, folder):
    """Alignments whose sequences and calls are copies of a few whole texts."""
    return (
        alignments(spark, folder)
        .withColumn("seq", F.expr(COPIED_SEQ))
        .withColumn(
            "tags",
            F.array(F.concat(F.lit("XM:Z:"), F.expr(COPIED_XM)), F.get("tags", F.lit(1))),
        )
    )
