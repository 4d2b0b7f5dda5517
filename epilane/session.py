"""Session settings, the shared folder and lineage cutting used by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Skewed join keys (a hot chromosome bin, read name or alignment key) are split
# at run time, also where the split costs one more exchange further up.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows of long texts: a Python worker holds one batch at a time.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


# Folders of local sessions without a shared folder, by application.
_own_folders: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _hadoop_path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``, with
    its scheme, so that Spark and Python workers take it alike.

    Only a local session without that setting gets one folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="epilane-shared-")
        folder = _own_folders[app]
    system, path = _hadoop_path(spark, folder)
    return re.sub("^file:/+", "file:///", system.makeQualified(path).toString()).rstrip("/")


# Shuffle files go when the query that wrote them ends, not when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Queries made within leave no shuffle files behind: for writes whose plan never runs again."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with dropping_shuffles(df.sparkSession):
        # A plan of its own: that of ``df`` may have run, or run again.
        return df.select("*").checkpoint(eager=True)


class Scratch:
    """Tables and files of one call in the shared folder, removed at its end.

    ``with Scratch(spark) as scratch:`` write with ``table`` or below ``path``, and
    return ``scratch.result(df)``, which is checkpointed before the files go.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/epilane-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = f"{self.path}/{name}"
        with dropping_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            system, path = _hadoop_path(self.spark, f"{self.path}/{name}")
            system.delete(path, True)

    def result(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df)

    def __exit__(self, *_) -> None:
        system, path = _hadoop_path(self.spark, self.path)
        system.delete(path, True)
