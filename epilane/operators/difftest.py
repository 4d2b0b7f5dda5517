"""Pairwise comparison of sample groups over regions.

One aggregation per region computes every group's statistics side by side; the pairs
are unfolded from that single row, so there is one shuffle and no self-join.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.functions.pvalues import normal_two_sided, t_two_sided

KEYS = ["chrom", "start", "end", "cpg"]


def check_groups(groups: dict[str, list[str]]) -> None:
    """At least two groups, and no sample in two of them."""
    if len(groups) < 2:
        raise ValueError("need at least two groups of samples")
    seen: set[str] = set()
    for name, samples in groups.items():
        if not samples:
            raise ValueError(f"group {name} has no samples")
        for sample in samples:
            if sample in seen:
                raise ValueError(f"sample {sample} listed twice")
            seen.add(sample)


def group_stats(
    regions: DataFrame, groups: dict[str, list[str]], keys: list[str] | None = None
) -> DataFrame:
    """One row per region with a struct column per group: number of samples with
    data, mean, variance and range of the fractions, and summed counts."""
    check_groups(groups)
    keys = keys or KEYS
    frac = F.col("x") / F.col("n")
    aggs = []
    for i, samples in enumerate(groups.values()):
        mine = F.col("sample").isin(*samples) & (F.col("n") > 0)
        value = F.when(mine, frac)
        aggs.append(
            F.struct(
                F.count(value).alias("k"),
                F.avg(value).alias("mean"),
                F.var_samp(value).alias("var"),
                F.min(value).alias("low"),
                F.max(value).alias("high"),
                F.sum(F.when(mine, F.col("n"))).alias("n"),
                F.sum(F.when(mine, F.col("x"))).alias("x"),
            ).alias(f"g{i}")
        )
    wanted = [s for samples in groups.values() for s in samples]
    return regions.filter(F.col("sample").isin(*wanted)).groupBy(*keys).agg(*aggs)


def _unfold(stats: DataFrame, groups: dict[str, list[str]], keys: list[str]) -> DataFrame:
    names = list(groups)
    pairs = [
        F.struct(
            F.lit(names[i]).alias("g1"),
            F.lit(names[j]).alias("g2"),
            F.col(f"g{i}").alias("a"),
            F.col(f"g{j}").alias("b"),
        )
        for i, j in combinations(range(len(names)), 2)
    ]
    return stats.select(*keys, F.explode(F.array(*pairs)).alias("pair")).select(*keys, "pair.*")


def _mean_pairs(regions, groups, keys):
    rows = _unfold(group_stats(regions, groups, keys), groups, keys)
    return rows.withColumns(
        {
            "mu1": F.col("a.mean"),
            "mu2": F.col("b.mean"),
            "diff": F.col("b.mean") - F.col("a.mean"),
        }
    )


def pairwise_diff(
    regions: DataFrame, groups: dict[str, list[str]], min_diff: float = 0.0, min_cpg: int = 0,
    keys: list[str] | None = None,
) -> DataFrame:
    """Mean differences of every pair of groups. A region is kept, with all its
    pairs, if the largest absolute difference reaches ``min_diff``."""
    keys = keys or KEYS
    names = list(groups)
    stats = group_stats(regions.filter(F.col("cpg") >= min_cpg), groups, keys)
    diffs = [
        F.abs(F.col(f"g{j}.mean") - F.col(f"g{i}.mean"))
        for i, j in combinations(range(len(names)), 2)
    ]
    largest = F.greatest(*diffs) if len(diffs) > 1 else diffs[0]
    rows = _unfold(stats.filter(largest >= min_diff), groups, keys)
    return rows.select(
        *keys,
        "g1",
        "g2",
        F.col("a.mean").alias("mu1"),
        F.col("b.mean").alias("mu2"),
        (F.col("b.mean") - F.col("a.mean")).alias("diff"),
    )


def welch_pairs(
    regions: DataFrame, groups: dict[str, list[str]], keys: list[str] | None = None
) -> DataFrame:
    """Welch statistics ``t`` (first minus second group), ``df`` and ``pval`` per pair.

    ``pval`` is NULL if a group has fewer than two values, 1 for equal means, 0 if
    both groups are constant and differ.
    """
    keys = keys or KEYS
    a, b = F.col("a"), F.col("b")
    va, vb = a["var"] / a["k"], b["var"] / b["k"]
    enough = (a["k"] >= 2) & (b["k"] >= 2)
    flat = (a["low"] == a["high"]) & (b["low"] == b["high"])
    testable = enough & ~flat
    rows = _mean_pairs(regions, groups, keys).withColumns(
        {
            "t": F.when(testable, (a["mean"] - b["mean"]) / F.sqrt(va + vb)),
            "df": F.when(
                testable,
                (va + vb) * (va + vb) / (va * va / (a["k"] - 1) + vb * vb / (b["k"] - 1)),
            ),
        }
    )
    pval = (
        F.when(~enough | F.col("diff").isNull(), F.lit(None).cast("double"))
        .when(F.col("diff") == 0, F.lit(1.0))
        .when(flat, F.lit(0.0))
        .otherwise(t_two_sided(F.col("t"), F.col("df")))
    )
    return rows.select(*keys, "g1", "g2", "mu1", "mu2", "diff", "t", "df", pval.alias("pval"))


def ztest_pairs(
    regions: DataFrame, groups: dict[str, list[str]], keys: list[str] | None = None
) -> DataFrame:
    """Two-proportion z-test on the pooled counts of every pair of groups."""
    keys = keys or KEYS
    rows = _unfold(group_stats(regions, groups, keys), groups, keys)
    a, b = F.col("a"), F.col("b")
    pooled = (a["x"] + b["x"]) / (a["n"] + b["n"])
    diff = b["x"] / b["n"] - a["x"] / a["n"]
    spread = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / a["n"] + F.lit(1.0) / b["n"]))
    both = a["n"].isNotNull() & b["n"].isNotNull()
    z = F.when(both, F.when(pooled.isin(0.0, 1.0), F.lit(0.0)).otherwise(diff / spread))
    return rows.select(
        *keys,
        "g1",
        "g2",
        (a["x"] / a["n"]).alias("mu1"),
        (b["x"] / b["n"]).alias("mu2"),
        diff.alias("diff"),
        z.alias("z"),
    ).withColumn("pval", normal_two_sided("z"))


def reportable(
    min_diff: float = 0.0,
    max_p: float = 1.0,
    up: bool = False,
    down: bool = False,
    keep_na_diff: bool = False,
    keep_na_p: bool = False,
) -> Column:
    """Reporting rule on ``diff`` and ``pval``; ``up`` and ``down`` exclude zero."""
    diff, pval = F.col("diff"), F.col("pval")
    good = F.abs(diff) >= min_diff
    if up:
        good = good & (diff > 0)
    if down:
        good = good & (diff < 0)
    return F.when(diff.isNull(), F.lit(keep_na_diff)).otherwise(good) & F.when(
        pval.isNull(), F.lit(keep_na_p)
    ).otherwise(pval <= max_p)


def diff_meth(
    regions: DataFrame,
    groups: dict[str, list[str]],
    test: str = "welch",
    min_cpg: int = 0,
    min_diff: float = 0.0,
    max_p: float = 1.0,
    up: bool = False,
    down: bool = False,
    keep_na_diff: bool = False,
    keep_na_p: bool = False,
    keys: list[str] | None = None,
) -> DataFrame:
    """Compare groups; a region is kept, with all its pairs, if any pair is reportable.

    ``test`` is ``'none'``, ``'ztest'`` or ``'welch'``. With two groups the result is
    the two-group comparison.
    """
    keys = keys or KEYS
    big = regions.filter(F.col("cpg") >= min_cpg)
    if test == "none":
        return pairwise_diff(big, groups, min_diff, keys=keys)
    if test not in ("welch", "ztest"):
        raise ValueError("test must be 'none', 'ztest' or 'welch'")
    rows = (welch_pairs if test == "welch" else ztest_pairs)(big, groups, keys)
    if test == "ztest":
        rule = reportable(min_diff, max_p)
    else:
        rule = reportable(min_diff, max_p, up, down, keep_na_diff, keep_na_p)
    pairs = F.collect_list(F.struct(*[c for c in rows.columns if c not in keys]))
    folded = rows.groupBy(*keys).agg(pairs.alias("pairs"), F.bool_or(rule).alias("keep"))
    return folded.filter("keep").select(*keys, F.inline("pairs"))


def with_samples(
    tests: DataFrame,
    regions: DataFrame,
    samples: list[str],
    keep: list[str] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """``tests`` with the fraction of each sample, and the ``keep`` columns of the region.

    ``keep`` columns (a gene, a distance) need not be grouping keys; the least value of a
    region is taken.
    """
    keys = keys or KEYS
    cells = [
        F.max(F.when((F.col("sample") == s) & (F.col("n") > 0), F.col("x") / F.col("n"))).alias(s)
        for s in samples
    ]
    carried = [F.min(f"`{c}`").alias(c) for c in keep or []]
    return tests.join(regions.groupBy(*keys).agg(*carried, *cells), keys, "left")


def specific_diffs(df: DataFrame, direction: str, first: str | None = None, second: str | None = None):
    """Rows changed in the first comparison but not half as much in the second.

    The comparisons are the third- and second-last columns unless named.
    """
    first = first or df.columns[-3]
    second = second or df.columns[-2]
    v1, v2 = F.col(f"`{first}`"), F.col(f"`{second}`")
    if direction == "up":
        return df.filter((v1 >= 0.1) & (v2 < v1 / 2))
    if direction == "down":
        return df.filter((v1 <= -0.1) & (v2 > v1 / 2))
    raise ValueError("direction must be 'up' or 'down'")
