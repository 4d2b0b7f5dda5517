"""Region pileups: reads over a region laid out in shared columns.

A region's columns are its reference positions plus, before a position, as many
insertion columns as the longest insertion any read has there. Column places depend
on the insertions only, so they are worked out once per distinct read span and
joined to the reads; no task holds a region's reads together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.functions.cigar import cigar_indel, cigar_ops, gap_string
from epilane.functions.sam import tag
from epilane.functions.sequence import mask_context
from epilane.operators.intervals import interval_join, overlap_join, slice_genome
from epilane.operators.ordered import running
from epilane.operators.regions import cluster_sites
from epilane.session import cut_lineage

SPAN = ["name", "pos", "last"]


def overlapping_reads(sam: DataFrame, bed: DataFrame) -> DataFrame:
    """Records overlapping each region, with ``loc3`` one past their last base, which
    still counts as touching a region that starts there."""
    loc3 = F.col("pos") + F.length("seq") + cigar_indel(F.col("cigar"))
    reads = sam.select(
        "line_no",
        "qname",
        F.col("rname").alias("chrom"),
        "pos",
        # Out of a generator: the join's filters on it would be pushed below a plain column,
        # where the records' text and CIGAR would be worked out once more for each.
        F.explode(F.array(loc3.cast("bigint"))).alias("loc3"),
        "cigar",
        "seq",
        "tags",
    )
    regions = bed.select("name", "chrom", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hits = overlap_join(reads, regions, ("pos", "loc3"), ("_s", "_e")).drop("_s", "_e")
    # Read after the join: records that touch no region need not have the tag.
    return hits.withColumn("xm", tag(F.col("tags"), "XM")).drop("tags")


def _bounds(reads: DataFrame) -> DataFrame:
    return reads.groupBy("name", "chrom").agg(
        F.min("pos").alias("min_loc"), F.max("loc3").alias("max_loc")
    )


def region_genome(sam: DataFrame, bed: DataFrame, genome: DataFrame, chunk_size: int) -> DataFrame:
    """``name,chrom,min_loc,max_loc,seq``: upper-case reference under each region's reads."""
    return _genome_under(_bounds(overlapping_reads(sam, bed)), genome, chunk_size)


def _genome_under(bounds: DataFrame, genome: DataFrame, chunk_size: int) -> DataFrame:
    wanted = bounds.withColumns(
        {"start": F.col("min_loc") - 1, "end": F.col("max_loc") - 1}
    )
    text = slice_genome(wanted, genome, chunk_size)
    return wanted.join(text, ["chrom", "start", "end"]).select(
        "name", "chrom", "min_loc", "max_loc", F.upper("seq").alias("seq")
    )


def region_reads(sam: DataFrame, bed: DataFrame) -> DataFrame:
    """``name,line_no,qname,pos,pad,text``: gapped methylation string of every read
    and its distance from the region's leftmost read."""
    reads = overlapping_reads(sam, bed)
    bounds = reads.groupBy("name").agg(F.min("pos").alias("min_loc"))
    return reads.join(bounds, "name").select(
        "name",
        "line_no",
        "qname",
        "pos",
        (F.col("pos") - F.col("min_loc")).cast("bigint").alias("pad"),
        gap_string(F.col("xm"), F.col("cigar")).alias("text"),
    )


def order_pileup(rows: DataFrame) -> DataFrame:
    """Pileup rows by region and position."""
    return rows.orderBy("name", "pos", "line_no")


def render_pileup(rows: DataFrame) -> DataFrame:
    """Text line per row, left-padded to its place."""
    return rows.withColumn(
        "line", F.concat(F.repeat(F.lit(" "), F.col("pad").cast("int")), F.col("text"))
    )


def _laid_out(cigar: Column, text: Column, pos: Column) -> Column:
    """``base``: one character per reference position; ``ins``: inserted text by the
    reference position it precedes."""
    start = F.struct(
        F.lit(1).alias("at"),
        pos.cast("bigint").alias("ref"),
        F.lit("").alias("base"),
        F.array().cast("array<struct<p:bigint,text:string>>").alias("ins"),
    )

    def step(acc, run):
        piece = F.substring(text, acc["at"], run["len"])
        here = F.struct(acc["ref"].alias("p"), piece.alias("text"))
        inserted, deleted = run["op"] == "I", run["op"] == "D"
        return F.struct(
            F.when(deleted, acc["at"]).otherwise(acc["at"] + run["len"]).alias("at"),
            F.when(inserted, acc["ref"]).otherwise(acc["ref"] + run["len"]).alias("ref"),
            F.when(inserted, acc["base"])
            .otherwise(
                F.concat(
                    acc["base"],
                    F.when(deleted, F.repeat(F.lit("-"), run["len"])).otherwise(piece),
                )
            )
            .alias("base"),
            F.when(inserted, F.concat(acc["ins"], F.array(here))).otherwise(acc["ins"]).alias("ins"),
        )

    kept = F.filter(cigar_ops(cigar), lambda r: r["op"].isin("M", "I", "D"))
    return F.aggregate(kept, start, step)


def _inserted_at(p: Column) -> Column:
    """Own inserted text right before reference position ``p``."""
    return F.array_join(
        F.transform(F.filter("ins", lambda x: x["p"] == p), lambda x: x["text"]), ""
    )


def _layout(sam, bed, text, genome=None, chunk_size=None):
    """Rows with base and inserted text, and the insertion columns of every region."""
    laid = overlapping_reads(sam, bed).withColumn(
        "l", _laid_out(F.col("cigar"), text, F.col("pos"))
    )
    # The reads of the regions are read by every step below, so they are written once.
    stored = cut_lineage(
        laid.select(
            "name",
            F.lit("read").alias("kind"),
            "line_no",
            "qname",
            "pos",
            (F.col("l.ref") - 1).alias("last"),
            F.col("l.base").alias("base"),
            F.col("l.ins").alias("ins"),
            "chrom",
            "loc3",
        )
    )
    bounds = cut_lineage(_bounds(stored))
    rows = stored.drop("chrom", "loc3")
    lengths = rows.filter(F.size("ins") > 0).select("name", F.inline("ins"), "line_no")
    columns = cut_lineage(
        lengths.groupBy("name", "p", "line_no")
        .agg(F.sum(F.length("text")).alias("len"))
        .groupBy("name", "p")
        .agg(F.max("len").alias("len"))
    )
    if genome is not None:
        under = _genome_under(bounds, genome, chunk_size).select(
            "name",
            F.lit("genome").alias("kind"),
            F.lit(None).cast("bigint").alias("line_no"),
            F.lit("genome").alias("qname"),
            F.col("min_loc").alias("pos"),
            (F.col("max_loc") - 1).alias("last"),
            F.col("seq").alias("base"),
            F.array().cast("array<struct<p:bigint,text:string>>").alias("ins"),
        )
        rows = rows.unionByName(under)
    return rows, columns, bounds


def _span_columns(rows: DataFrame, columns: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per distinct span: insertion columns before it, at its start and inside it."""
    # Several steps below read the spans, a count of their levels among them.
    spans = cut_lineage(rows.select(*SPAN).distinct())
    starts = spans.select("name", "pos").distinct()
    marks = starts.select("name", "pos", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("len"))
    marks = marks.unionByName(
        columns.select("name", F.col("p").alias("pos"), F.lit(1).alias("kind"), "len")
    )
    before = (
        running(marks, ["name"], ["pos", "kind"], {"before": ("sum", F.col("len"))})
        .filter("kind = 0")
        .select("name", "pos", "before")
    )
    inside = (
        interval_join(
            columns.select("name", "p", "len"),
            spans.withColumn("after", F.col("pos") + 1),
            keys=["name"],
            pos="p",
            start="after",
            end="last",
            closed=True,
        )
        .groupBy(*SPAN)
        .agg(F.array_sort(F.collect_list(F.struct("p", "len"))).alias("inner"))
    )
    at_start = columns.select("name", F.col("p").alias("pos"), F.col("len").alias("at_start"))
    found = (
        spans.join(before, ["name", "pos"])
        .join(at_start, ["name", "pos"], "left")
        .join(inside, SPAN, "left")
        .join(bounds.select("name", "min_loc"), "name")
        .select(
            *SPAN,
            (F.col("pos") - F.col("min_loc") + F.col("before")).alias("left"),
            F.coalesce("at_start", F.lit(0)).alias("at_start"),
            F.coalesce(
                "inner", F.array().cast("array<struct<p:bigint,len:bigint>>")
            ).alias("inner"),
        )
    )
    # What depends on the span alone is worked out here, not per read: the piece of base
    # text before each boundary, and the gap of a read without an insertion there.
    pos = F.col("pos")

    def begin(k):
        return F.when(k == 0, pos).otherwise(F.get("inner", k - 1)["p"])

    pieces = F.transform(
        "inner",
        lambda b, k: F.struct(
            b["p"].alias("p"),
            b["len"].cast("int").alias("len"),
            (begin(k) - pos + 1).cast("int").alias("at"),
            (b["p"] - begin(k)).cast("int").alias("size"),
            F.repeat(F.lit("-"), b["len"].cast("int")).alias("gap"),
        ),
    )
    tail = F.when(F.size("inner") == 0, pos).otherwise(F.element_at("inner", -1)["p"])
    return found.select(
        *SPAN,
        "left",
        "at_start",
        pieces.alias("pieces"),
        (tail - pos + 1).cast("int").alias("tail_at"),
    )


def _render(rows: DataFrame, spans: DataFrame) -> DataFrame:
    lead = _inserted_at(F.col("pos"))
    bare = F.size("ins") == 0

    def base_piece(b):
        return F.substring("base", b["at"], b["size"])

    # The read's own insertion at each boundary is looked up once.
    with_own = F.transform(
        "pieces",
        lambda b: F.struct(
            base_piece(b).alias("base"), b["len"].alias("len"), _inserted_at(b["p"]).alias("own")
        ),
    )
    tail = F.substring("base", F.col("tail_at"), F.length("base"))
    text = F.when(
        bare,
        F.concat(
            F.array_join(F.transform("pieces", lambda b: F.concat(base_piece(b), b["gap"])), ""),
            tail,
        ),
    ).otherwise(
        F.concat(
            F.when(
                lead != "",
                F.concat(
                    lead,
                    F.repeat(F.lit("-"), (F.col("at_start") - F.length(lead)).cast("int")),
                ),
            ).otherwise(F.lit("")),
            F.array_join(
                F.transform(
                    with_own,
                    lambda b: F.concat(
                        b["base"], b["own"], F.repeat(F.lit("-"), b["len"] - F.length(b["own"]))
                    ),
                ),
                "",
            ),
            tail,
            F.when(
                F.col("last") >= F.col("pos"), _inserted_at(F.col("last") + 1)
            ).otherwise(F.lit("")),
        )
    )
    pad = F.col("left") + F.when(bare | (lead == ""), F.col("at_start")).otherwise(F.lit(0))
    return rows.join(spans, SPAN).select(
        "name", "kind", "line_no", "qname", "pos", pad.cast("bigint").alias("pad"), text.alias("text")
    )


def region_alignment(
    sam: DataFrame, bed: DataFrame, genome: DataFrame | None = None, what: str = "xm", chunk_size: int | None = None
) -> DataFrame:
    """``name,kind,line_no,qname,pos,pad,text``: multiple alignment of a region's reads,
    and of the genome under them, over base and insertion columns."""
    if what not in ("xm", "seq"):
        raise ValueError("what must be 'xm' or 'seq'")
    text = mask_context(F.col("xm")) if what == "xm" else F.col("seq")
    rows, columns, bounds = _layout(sam, bed, text, genome, chunk_size)
    return _render(rows, _span_columns(rows, columns, bounds))


def _site_table(aligned: DataFrame, columns: DataFrame, bounds: DataFrame) -> DataFrame:
    """Merged CpG sites of each region: ``name,idx,col0,col1,site``."""
    pieces = F.regexp_extract_all("text", F.lit("[^zZ]*[zZ]"), F.lit(0))
    offsets = F.aggregate(
        pieces,
        F.array().cast("array<int>"),
        lambda acc, p: F.concat(
            acc,
            F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + F.length(p)),
        ),
    )
    called = (
        aligned.select("name", "pad", F.explode_outer(offsets).alias("i"))
        .filter(F.col("i").isNotNull())
        .select("name", (F.col("pad") + F.col("i")).alias("col"))
        .distinct()
    )

    placed = running(columns, ["name"], ["p"], {"cum": ("sum", F.col("len"))}).join(
        bounds.select("name", "min_loc", "max_loc"), "name"
    )
    totals = placed.filter(F.col("p") < F.col("max_loc")).groupBy("name").agg(
        F.sum("len").alias("inserted"),
        F.max(F.when(F.col("p") == F.col("min_loc"), F.col("len"))).alias("at_min"),
    )
    frame = (
        bounds.join(totals, "name", "left")
        .select(
            "name",
            "min_loc",
            F.coalesce("at_min", F.lit(0)).alias("at_min"),
            (F.col("max_loc") - F.col("min_loc") + F.coalesce("inserted", F.lit(0))).alias("width"),
        )
    )
    marks = called.select(
        "name", "col", F.lit(1).alias("kind"), F.lit(None).cast("struct<p:bigint,len:bigint,cum:bigint>").alias("ins")
    ).unionByName(
        placed.select(
            "name",
            (F.col("p") - F.col("min_loc") + F.col("cum") - F.col("len")).alias("col"),
            F.lit(0).alias("kind"),
            F.struct("p", "len", "cum").alias("ins"),
        )
    )
    near = (
        running(marks, ["name"], ["col", "kind"], {"seen": ("max", F.struct(F.coalesce("ins.p", F.lit(-1)).alias("p"), "ins"))})
        .filter("kind = 1")
        .join(frame, "name")
        .filter(F.col("col") < F.col("width"))
    )
    ins = F.col("seen.ins")
    first = ins["p"] - F.col("min_loc") + ins["cum"] - ins["len"]
    in_ins = ins.isNotNull() & (F.col("col") < first + ins["len"])
    chr_pos = (
        F.when(in_ins & (ins["p"] == F.col("min_loc")), F.col("min_loc") + F.col("col"))
        .when(in_ins, ins["p"] + F.col("at_min") - 1)
        .otherwise(
            F.col("col") + F.col("min_loc") - F.coalesce(ins["cum"], F.lit(0)) + F.col("at_min")
        )
    )
    located = cut_lineage(near.select("name", "col", chr_pos.alias("chr_pos")))
    # Neighbouring columns join two by two from the start of their run.
    runs = cluster_sites(
        located.select(F.col("name").alias("chrom"), F.col("col").alias("pos")), max_dist=1
    ).select(F.col("chrom").alias("name"), F.col("pos").alias("col"), F.col("region_start").alias("run"))
    second = (F.col("col") - F.col("run")) % 2
    sites = (
        located.join(runs, ["name", "col"])
        .groupBy("name", (F.col("col") - second).alias("col0"))
        .agg(
            F.max(F.when(second == 1, F.col("col"))).alias("col1"),
            F.max(F.when(second == 0, F.col("chr_pos"))).alias("chr_pos"),
        )
    )
    return running(sites, ["name"], ["col0"], {"seen": ("sum", F.lit(1))}).select(
        "name",
        (F.col("seen") - 1).alias("idx"),
        "col0",
        "col1",
        "chr_pos",
        F.concat(
            F.col("chr_pos").cast("string"),
            F.when(F.col("col1").isNotNull(), F.lit("+1")).otherwise(F.lit("")),
        ).alias("site"),
    )


def _letter(col):
    return F.when(
        col < F.col("stop"),
        F.substring("text", (col - F.col("pad") + 1).cast("int"), F.lit(1)),
    )


def _letters(col0, col1):
    """Letters of a read at the two columns of a site."""
    return F.when(col0 >= F.col("pad"), _letter(col0)).otherwise(F.lit(" ")), _letter(col1)


def _state(c0, c1, col1):
    return (
        F.when(c0 == "z", F.lit("0"))
        .when(c0 == "Z", F.lit("1"))
        .when(col1.isNull(), F.lit("x"))
        .when(c1.isNull(), F.lit("-"))
        .when(c1 == "z", F.lit("0"))
        .when(c1 == "Z", F.lit("1"))
        .otherwise(F.lit("x"))
    )


def _matrix(sam: DataFrame, bed: DataFrame):
    """Aligned reads, the sites of their regions, and the sites that each read span covers."""
    rows, columns, bounds = _layout(sam, bed, F.col("xm"))
    aligned = cut_lineage(
        _render(rows, _span_columns(rows, columns, bounds)).withColumn(
            "stop", F.col("pad") + F.length("text")
        )
    )
    sites = cut_lineage(_site_table(aligned, columns, bounds))
    spans = cut_lineage(aligned.select("name", "pad", "stop").distinct())
    covered = interval_join(
        sites.withColumn("hi", F.coalesce("col1", "col0")),
        spans,
        keys=["name"],
        pos="hi",
        start="pad",
        end="stop",
        closed=True,
    ).filter(F.col("col0") < F.col("stop"))
    return aligned, sites, covered


def region_cpg_matrix(sam: DataFrame, bed: DataFrame) -> DataFrame:
    """``name,line_no,qname,pos,pattern``: one ``0/1/-/x`` mark per merged CpG site."""
    aligned, sites, covered = _matrix(sam, bed)
    listed = covered.groupBy("name", "pad", "stop").agg(
        F.array_sort(F.collect_list(F.struct("idx", "col0", "col1"))).alias("sites")
    )
    sizes = sites.groupBy("name").agg(F.count(F.lit(1)).alias("n_sites"))

    def both(site):
        c0, c1 = _letters(site["col0"], site["col1"])
        return F.struct(c0.alias("c0"), c1.alias("c1"), site["col1"].alias("col1"))

    states = F.transform(F.transform("sites", both), lambda s: _state(s["c0"], s["c1"], s["col1"]))
    n = F.coalesce("n_sites", F.lit(0))
    head = F.get("sites", F.lit(0))["idx"]
    tail = F.get("sites", F.size("sites") - 1)["idx"]
    pattern = F.when(F.col("sites").isNull(), F.repeat(F.lit("-"), n.cast("int"))).otherwise(
        F.concat(
            F.repeat(F.lit("-"), head.cast("int")),
            F.array_join(states, ""),
            F.repeat(F.lit("-"), (n - 1 - tail).cast("int")),
        )
    )
    marked = aligned.join(listed, ["name", "pad", "stop"], "left").join(sizes, "name", "left")
    return marked.select("name", "line_no", "qname", "pos", pattern.alias("pattern"))


def region_cpg_summary(sam: DataFrame, bed: DataFrame) -> DataFrame:
    """``name,chr_pos,site,meth,unmeth``: marks per merged CpG site."""
    aligned, _, covered = _matrix(sam, bed)
    c0, c1 = _letters(F.col("col0"), F.col("col1"))
    flat = (
        aligned.select("name", "pad", "stop", "text")
        .join(covered, ["name", "pad", "stop"])
        .select("name", "chr_pos", "site", _state(c0, c1, F.col("col1")).alias("state"))
    )
    return flat.groupBy("name", "chr_pos", "site").agg(
        F.count_if(F.col("state") == "1").alias("meth"),
        F.count_if(F.col("state") == "0").alias("unmeth"),
    )


def order_sites(summary: DataFrame) -> DataFrame:
    """Site summary by region and genome position."""
    return summary.orderBy("name", "chr_pos", "site")
