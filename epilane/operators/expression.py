"""Reshaping gene expression tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gene_matrix(feature_counts: DataFrame) -> DataFrame:
    """``Symbol,Length,<sample>...`` with rounded counts; samples are named by the
    folder of their file."""
    first, length, samples = feature_counts.columns[0], feature_counts.columns[5], feature_counts.columns[6:]

    def whole(name):
        return F.round(F.col(f"`{name}`").cast("double")).cast("bigint")

    return feature_counts.select(
        F.col(f"`{first}`").alias("Symbol"),
        whole(length).alias("Length"),
        *[whole(name).alias(name.split("/")[-2]) for name in samples],
    )


def _compared(diff: DataFrame, exclude: list[str] | None) -> DataFrame:
    """Rows without excluded samples; the fold change of untested rows is 0."""
    rows = diff
    if exclude:
        rows = rows.filter(~F.col("sample_1").isin(*exclude) & ~F.col("sample_2").isin(*exclude))
    return rows.withColumn(
        "value", F.when(F.col("status") == "OK", F.col("fold")).otherwise(F.lit(0.0))
    )


def _significant(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gene").agg(F.bool_or(F.col("significant") == "yes").alias("s")).filter("s").select(
        "gene"
    )


def significant_genes(diff: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """``gene,sample_1,sample_2,value`` of genes significant in any comparison left."""
    rows = _compared(diff, exclude)
    return rows.join(_significant(rows), "gene", "left_semi").select(
        "gene", "sample_1", "sample_2", "value"
    )


def order_genes(df: DataFrame) -> DataFrame:
    """Rows by gene name."""
    return df.orderBy("gene")


def baseline_folds(diff: DataFrame, baseline: str, exclude: list[str] | None = None) -> DataFrame:
    """``gene,sample,value``: fold changes against one sample, for significant genes.

    Comparisons recorded the other way round are negated. Infinite values become the
    largest finite absolute fold change of a significant comparison.
    """
    rows = _compared(diff, exclude)
    infinite = F.abs("fold") == float("inf")
    top = rows.agg(
        F.coalesce(
            F.max(F.when((F.col("significant") == "yes") & ~infinite, F.abs("fold"))), F.lit(0.0)
        ).alias("top")
    ).scalar()
    from_base, to_base = F.col("sample_1") == baseline, F.col("sample_2") == baseline
    finite = F.when(F.abs("value") == float("inf"), F.signum("value") * top).otherwise(
        F.col("value")
    )
    signed = F.when(from_base, finite).otherwise(-finite) + F.lit(0.0)
    return (
        rows.join(_significant(rows), "gene", "left_semi")
        .filter(from_base | to_base)
        .select(
            "gene",
            F.when(from_base, F.col("sample_2")).otherwise(F.col("sample_1")).alias("sample"),
            signed.alias("value"),
        )
    )


def baseline_samples(diff: DataFrame, baseline: str, exclude: list[str] | None = None) -> list[str]:
    """Sorted partners of the baseline sample; none is an error. One small aggregate."""
    rows = _compared(diff, exclude)
    partners = (
        rows.filter((F.col("sample_1") == baseline) | (F.col("sample_2") == baseline))
        .select(
            F.when(F.col("sample_1") == baseline, F.col("sample_2"))
            .otherwise(F.col("sample_1"))
            .alias("sample")
        )
        .distinct()
    )
    names = sorted(row["sample"] for row in partners.collect())
    if not names:
        raise ValueError(f"baseline sample {baseline} not found")
    return names


def heatmap(
    diff: DataFrame, baseline: str, exclude: list[str] | None = None, samples: list[str] | None = None
) -> DataFrame:
    """``gene,<sample>...``: fold changes against ``baseline``, one column per partner."""
    samples = samples or baseline_samples(diff, baseline, exclude)
    folds = baseline_folds(diff, baseline, exclude)
    return folds.groupBy("gene").agg(
        *[F.max(F.when(F.col("sample") == name, F.col("value"))).alias(name) for name in samples]
    )
