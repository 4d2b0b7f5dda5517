"""Running CpG counts over alignment text that keeps arriving.

The batch tools read alignments from a pipe; here a folder the aligner fills is a stream.
Single-end records are counted as they come (``stream_cpg_counts``). Mates that overlap
must be compared first: ``stream_mate_calls`` keeps the sites of a pair's first record as
state of its name until the other one arrives, and gives settled calls, whose counts are
those of the batch operators on the finished folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epilane.functions import sam as s
from epilane.operators.calls import cpg_counts, place_calls, unfold_calls
from epilane.sources.alignments import parse_records
from epilane.sources.lines import required_fields

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MATE_UNMAPPED = 8
SETTLED = "chrom string, loc bigint, call string, ins boolean"


def stream_sam(spark: SparkSession, folder: str, ordered: bool = False, files: int | None = None) -> DataFrame:
    """Alignment records from files added to ``folder``, up to ``files`` of them at a time.

    ``ordered`` reads each file as a whole, so files should be an aligner's portions, and
    makes ``line_no`` a struct that sorts by the file's time, its name and the line.
    """
    source = spark.readStream.format("text")
    if files:
        source = source.option("maxFilesPerTrigger", files)
    if ordered:
        place = F.struct(
            F.col("_metadata.file_modification_time").alias("time"),
            F.col("_metadata.file_path").alias("file"),
            F.col("pos").alias("line"),
        )
        whole = source.option("wholetext", True).load(folder)
        text = whole.select("_metadata", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "value"))
    else:
        place = F.lit(0).cast("bigint")
        text = source.load(folder)
    lines = text.select(place.alias("line_no"), F.rtrim("value").alias("line"))
    records = lines.filter((F.col("line") != "") & ~F.startswith("line", F.lit("@")))
    return parse_records(records, required_fields(F.col("line"), 11, "SAM record"))


def stream_cpg_counts(records: DataFrame, min_cov: int = 1) -> DataFrame:
    """Counts per site so far, for output mode ``complete`` or ``update``. The state is
    one row per site. A paired record fails."""
    placed = place_calls(records)
    paired = F.raise_error(F.concat(F.lit("paired record in stream: "), F.col("qname")))
    checked = placed.withColumn(
        "chrom", F.when(F.col("paired"), paired.cast("string")).otherwise(F.col("chrom"))
    )
    return cpg_counts(unfold_calls(checked, "chrom"), min_cov)


class MateProcessor(StatefulProcessor):
    """Calls of paired records by read name: the second record skips the sites of the first.

    The state of a name is the sites of its first record. It goes when the second record
    has come, or by a timer when that stays away for ``wait_ms`` (never with None).
    """

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "locs array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: tuple(r["line_no"])):
            calls = row["calls"] or []
            if self.first.exists():
                seen = set(self.first.get()[0] or [])
                calls = [c for c in calls if c["loc"] not in seen]
                self._forget()
            else:
                self.first.update(([c["loc"] for c in calls],))
                if self.wait_ms is not None:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            for c in calls:
                yield Row(chrom=row["chrom"], loc=c["loc"], call=c["call"], ins=c["ins"])

    def _forget(self) -> None:
        self.first.clear()
        if self.wait_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_mate_calls(records: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """``chrom,loc,call,ins`` of settled calls, for output mode ``append``.

    ``records`` come from ``stream_sam`` with ``ordered``. Unpaired records pass through;
    paired ones meet by name in keyed state, which holds names with one record so far;
    records whose mate is unmapped need none. A name is taken to have two primary records.
    With ``wait_ms`` one that waits longer for the other is forgotten, and a mate that
    comes later counts as the first of a pair; such a query runs until it is stopped,
    because its timers go on without new files.
    """
    spark = records.sparkSession
    if spark.conf.get(STATE_STORE, "") != ROCKS:
        raise ValueError(f"set {STATE_STORE} to {ROCKS}")
    alone = s.flag(F.col("flag"), MATE_UNMAPPED)
    flags = F.when(alone, F.col("flag").bitwiseAND(~s.PAIRED)).otherwise(F.col("flag"))
    placed = place_calls(records.withColumn("flag", flags))
    single = unfold_calls(placed.filter(~F.col("paired")), "chrom")
    settled = (
        placed.filter("paired")
        .groupBy("qname")
        .transformWithState(MateProcessor(wait_ms), SETTLED, "append", "None" if wait_ms is None else "ProcessingTime")
    )
    return single.select("chrom", "loc", "call", "ins").unionByName(settled)


def settled_counts(calls: DataFrame, min_cov: int = 1) -> DataFrame:
    """Counts per site of settled calls, a table or a stream of one."""
    return cpg_counts(calls, min_cov)
