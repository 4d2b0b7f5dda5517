import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from epilane.session import tune

    session = (
        SparkSession.builder.master("local[8]")
        .appName("epilane-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


SAM_SCHEMA = (
    "line_no long, qname string, flag int, rname string, pos long, mapq int, cigar string,"
    " rnext string, pnext long, tlen int, seq string, qual string, tags array<string>"
)


@pytest.fixture(scope="session")
def make_sam(spark):
    """Alignment table from dicts; unset fields get plain values."""

    def build(records):
        rows = []
        for i, r in enumerate(records):
            seq = r.get("seq", "A" * 10)
            rows.append(
                (
                    r.get("line_no", i),
                    r.get("qname", f"r{i}"),
                    r.get("flag", 0),
                    r.get("rname", "chr1"),
                    r.get("pos", 100),
                    60,
                    r.get("cigar", f"{len(seq)}M"),
                    r.get("rnext", "*"),
                    r.get("pnext", 0),
                    0,
                    seq,
                    r.get("qual", "I" * len(seq)),
                    r.get("tags", []),
                )
            )
        return spark.createDataFrame(rows, SAM_SCHEMA)

    return build
