"""Counts stored by place, so that steps over sites meet without a shuffle.

The table is bucketed by (chromosome, tile) and sorted by position. Grouping by site,
clustering in tiles and joining sites back to counts all ask for rows of a tile together,
which a bucket gives; a chromosome is spread over as many buckets as it has tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilane.operators.ordered import TILE

PLACE = ["chrom", "tile"]


def store_counts(counts: DataFrame, name: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``sample,chrom,pos,meth,unmeth`` as the bucketed table ``name`` and return it,
    with the ``tile`` of each row. ``path`` makes it an external table."""
    spark = counts.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiled = counts.withColumn("tile", F.floor(F.col("pos") / TILE))
    writer = tiled.repartition(n, *PLACE).write.bucketBy(n, *PLACE).sortBy(*PLACE, "pos")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)
