"""Wald test of beta-binomial counts with shrunken dispersions, and its reporting.

Follows the published description of the method: pseudo-counted group means, a
log-normal prior of dispersions learnt from all regions, a penalised likelihood per
region, and a Wald statistic. Not bit-compatible with any package.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from epilane.functions.pvalues import log_gamma, normal_two_sided
from epilane.operators.difftest import KEYS, check_groups
from epilane.operators.ordered import exact_quantiles, running
from epilane.session import cut_lineage

# Fixed values of the method (Feng, Conneely, Wu 2014, a Bayesian hierarchical model for
# differentially methylated loci): pseudo-counts of the mean, and the spread of a normal
# distribution's quartiles in deviations. Defaults of arguments: the counts over which a
# sample teaches the prior, and the search range of log dispersion.
PSEUDO_X, PSEUDO_N = 0.5, 1.0
QUARTILE_FACTOR = 1.39
MIN_COVERAGE = 10
LOG_RANGE = (-5.0, float(np.log(0.99)))
# Steps of the search, and the half width of the parabola through its end.
STEPS, HALF_WIDTH = 40, 1e-3


def _padded(lists: pd.Series) -> np.ndarray:
    """Rows of unequal length as one matrix, filled up with zeros."""
    sizes = lists.str.len().to_numpy(np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.concatenate([[], *lists])
    return out


@F.pandas_udf(DoubleType())
def shrunken_dispersion(
    n: pd.Series,
    x: pd.Series,
    mu: pd.Series,
    prior_mean: pd.Series,
    prior_sd: pd.Series,
    low: pd.Series,
    high: pd.Series,
) -> pd.Series:
    """Dispersion that maximises the beta-binomial likelihood of the samples'
    ``n``/``x`` arrays plus the log-normal prior; golden-section search per region,
    with log dispersion between ``low`` and ``high``, then the top of a parabola: near
    its top the likelihood is too flat for comparisons to place it well."""
    total, meth = _padded(n), _padded(x)
    mean = np.clip(mu.to_numpy(float), 1e-5, 1 - 1e-5)[:, None]
    centre, spread = prior_mean.to_numpy(float), prior_sd.to_numpy(float)

    def goal(log_phi):
        size = np.exp(-log_phi)[:, None] - 1.0
        a, b = mean * size, (1 - mean) * size
        fit = (
            log_gamma(meth + a) + log_gamma(total - meth + b) - log_gamma(total + a + b)
            - log_gamma(a) - log_gamma(b) + log_gamma(a + b)
        )
        fit = np.where(total > 0, fit, 0.0).sum(axis=1)
        return fit - (log_phi - centre) ** 2 / (2 * spread**2)

    least, most = low.to_numpy(float), high.to_numpy(float)
    low, high = least.copy(), most.copy()
    ratio = (np.sqrt(5) - 1) / 2
    left, right = high - ratio * (high - low), low + ratio * (high - low)
    at_left, at_right = goal(left), goal(right)
    for _ in range(STEPS):
        # One inner point becomes the other, so each step works out one new value.
        better = at_left > at_right
        high, low = np.where(better, right, high), np.where(better, low, left)
        fresh = np.where(better, high - ratio * (high - low), low + ratio * (high - low))
        value = goal(fresh)
        left, right = np.where(better, fresh, right), np.where(better, left, fresh)
        at_left, at_right = (
            np.where(better, value, at_right),
            np.where(better, at_left, value),
        )
    middle = (low + high) / 2
    before, here, after = (goal(middle + k * HALF_WIDTH) for k in (-1, 0, 1))
    bend = before - 2 * here + after
    shift = HALF_WIDTH * (before - after) / np.where(bend < 0, 2 * bend, -1.0)
    near = (bend < 0) & (np.abs(shift) <= HALF_WIDTH)
    top = np.clip(np.where(near, middle + shift, middle), least, most)
    return pd.Series(np.exp(top))


def _group_rows(regions: DataFrame, groups: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """One row per region and group; the sample arrays are as long as the group."""
    named = F.coalesce(
        *[F.when(F.col("sample").isin(*samples), F.lit(g)) for g, samples in groups.items()]
    )
    data = regions.withColumn("group", named).filter(F.col("group").isNotNull() & (F.col("n") > 0))
    frac = F.col("x") / F.col("n")
    listed = F.array_sort(F.collect_list(F.struct("sample", "n", "x")))
    return data.groupBy(*keys, "group").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total_n"),
        F.sum("x").alias("total_x"),
        F.min("n").alias("least_n"),
        F.avg(frac).alias("mean_frac"),
        F.var_samp(frac).alias("var_frac"),
        listed.alias("samples"),
    )


def _priors(
    rows: DataFrame,
    groups: dict[str, list[str]],
    prior: str | tuple[float, float],
    min_coverage: int,
) -> DataFrame:
    """``group,prior_mean,prior_sd`` of log dispersion, from exact quartiles."""
    names = F.explode(F.array(*[F.lit(g) for g in groups])).alias("group")
    every = rows.sparkSession.range(1).select(names)
    if prior != "learn":
        mean, sd = prior
        return every.withColumns(
            {"prior_mean": F.lit(float(mean)), "prior_sd": F.lit(float(sd))}
        )
    sizes = F.coalesce(*[F.when(F.col("group") == g, F.lit(len(v))) for g, v in groups.items()])
    middle = F.least(F.greatest("mean_frac", F.lit(1e-5)), F.lit(1 - 1e-5))
    moment = F.col("var_frac") / middle / (1 - middle)
    usable = rows.filter(
        (F.col("k") == sizes) & (F.col("least_n") > min_coverage) & (F.col("var_frac") > 0)
    ).withColumn("log_phi", F.log(moment))
    found = exact_quantiles(usable, "group", "log_phi", [0.25, 0.5, 0.75])
    learnt = rows.sparkSession.createDataFrame(
        [(g, float(q[1]), float(q[2] - q[0])) for g, q in found.items()], "group string, middle double, spread double"
    )
    sd = F.col("spread") / QUARTILE_FACTOR
    problem = F.raise_error(
        F.concat(F.lit("no prior can be learnt, give one as (mean, sd), for group "), "group")
    ).cast("double")
    return every.join(learnt, "group", "left").select(
        "group",
        F.when(sd > 0, F.col("middle")).otherwise(problem).alias("prior_mean"),
        F.when(sd > 0, sd).otherwise(problem).alias("prior_sd"),
    )


def wald_pairs(
    regions: DataFrame,
    groups: dict[str, list[str]],
    keys: list[str] | None = None,
    prior: str | tuple[float, float] = "learn",
    min_coverage: int = MIN_COVERAGE,
    log_range: tuple[float, float] = LOG_RANGE,
) -> DataFrame:
    """``keys,g1,g2,mu1,mu2,diff,stat,pval,at_edge`` per region and pair of groups;
    ``diff`` is the later minus the earlier group.

    A pair with a group of one sample shares the dispersion of all its samples.
    ``prior`` is the mean and deviation of log dispersion, or ``"learn"``: from the
    regions where every sample of a group has more than ``min_coverage`` counts; without
    any such region, or without spread, that fails. The dispersion is sought within
    ``log_range``; ``at_edge`` is true where one of a pair lies on its border.
    """
    check_groups(groups)
    keys = keys or KEYS
    pairs = list(combinations(groups, 2))
    shared = [(a, b) for a, b in pairs if len(groups[a]) < 2 or len(groups[b]) < 2]
    rows = cut_lineage(_group_rows(regions, groups, keys))
    options = {"prior": prior, "min_coverage": min_coverage, "log_range": log_range}
    fitted = _fit(rows, groups, **options) if len(shared) < len(pairs) else None
    tested = _wald(fitted, [p for p in pairs if p not in shared], keys) if len(shared) < len(pairs) else None
    for a, b in shared:
        both = {"both": groups[a] + groups[b]}
        common = _fit(_group_rows(regions, both, keys), both, **options).select(
            *keys, F.col("phi").alias("shared_phi"), F.col("at_edge").alias("shared_edge")
        )
        part = _wald(
            rows.join(common, keys, "left")
            .withColumns(
                {
                    "phi": F.col("shared_phi"),
                    "at_edge": F.col("shared_edge"),
                    "mu": _pseudo_mean(),
                }
            )
            .filter(F.col("group").isin(a, b)),
            [(a, b)],
            keys,
        )
        tested = part if tested is None else tested.unionByName(part)
    return tested


def _pseudo_mean():
    return (F.col("total_x") + PSEUDO_X) / (F.col("total_n") + PSEUDO_N)


def _fit(rows: DataFrame, groups: dict[str, list[str]], prior, min_coverage, log_range) -> DataFrame:
    """Rows with mean ``mu`` and shrunken dispersion ``phi``. The prior table has one
    row per group."""
    low, high = map(float, log_range)
    priors = _priors(rows, groups, prior, min_coverage)
    fitted = rows.join(F.broadcast(priors), "group").withColumns(
        {
            "mu": _pseudo_mean(),
            "phi": shrunken_dispersion(
                F.transform("samples", lambda s: s["n"].cast("double")),
                F.transform("samples", lambda s: s["x"].cast("double")),
                _pseudo_mean(),
                F.col("prior_mean"),
                F.col("prior_sd"),
                F.lit(low),
                F.lit(high),
            ),
        }
    )
    edge = F.least(F.log("phi") - low, high - F.log("phi")) < 1e-6
    return fitted.withColumn("at_edge", edge)


def _wald(rows: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    mu, phi = F.col("mu"), F.col("phi")
    spread = F.aggregate(
        "samples",
        F.lit(0.0),
        lambda acc, s: acc + s["n"] * mu * (1 - mu) * (1 + (s["n"] - 1) * phi),
    ) / (F.col("total_n") * F.col("total_n"))
    names = sorted({g for p in pairs for g in p})
    cell = F.struct(mu.alias("mu"), F.col("spread").alias("var"), F.col("at_edge").alias("edge"))
    folded = (
        rows.withColumn("spread", spread)
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("group") == g, cell)).alias(f"m_{i}") for i, g in enumerate(names)])
    )
    place = {g: f"m_{i}" for i, g in enumerate(names)}
    unfolded = folded.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("g1"),
                        F.lit(b).alias("g2"),
                        F.col(place[a]).alias("a"),
                        F.col(place[b]).alias("b"),
                    )
                    for a, b in pairs
                ]
            )
        ),
    )
    diff = F.col("b.mu") - F.col("a.mu")
    return (
        unfolded.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(
            *keys,
            "g1",
            "g2",
            F.col("a.mu").alias("mu1"),
            F.col("b.mu").alias("mu2"),
            diff.alias("diff"),
            F.try_divide(diff, F.sqrt(F.col("a.var") + F.col("b.var"))).alias("stat"),
            (F.col("a.edge") | F.col("b.edge")).alias("at_edge"),
        )
        .select(*keys, "g1", "g2", "mu1", "mu2", "diff", "stat", normal_two_sided("stat").alias("pval"), "at_edge")
    )


def bh_fdr(tests: DataFrame, by: list[str] | None = None, p: str = "pval") -> DataFrame:
    """Add Benjamini-Hochberg ``fdr`` within each comparison.

    Equal p-values are counted before they are ordered; ranks and the running minimum
    from the largest p down are built over tiles of the p axis.
    """
    by = by or ["g1", "g2"]
    value = F.col("_p")
    tests = cut_lineage(tests)
    levels = cut_lineage(
        tests.filter(F.col(p).isNotNull())
        .groupBy(*by, F.col(p).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # Fine steps near zero on a log scale, even steps elsewhere; both rise with p.
    tile = F.when(value <= 0, F.lit(-10_000_000)).when(
        value < 0.01, F.floor(F.log10(value) * 1000)
    ).otherwise(F.floor(value * 10000))
    ranked = running(levels, by, ["_p"], {"_rank": ("sum", F.col("_n"))}, tile)
    sizes = levels.groupBy(*by).agg(F.sum("_n").alias("_m"))
    raw = cut_lineage(
        ranked.join(sizes, by).select(
            *by,
            "_p",
            (-value).alias("_back"),
            (value * F.col("_m") / F.col("_rank")).alias("_raw"),
            (-tile).alias("_tile_back"),
        )
    )
    lowest = running(raw, by, ["_back"], {"_low": ("min", F.col("_raw"))}, F.col("_tile_back"))
    return tests.join(
        lowest.select(*by, F.col("_p").alias(p), F.least("_low", F.lit(1.0)).alias("fdr")),
        [*by, p],
        "left",
    ).select(*tests.columns, "fdr")


def dmr_pass(
    min_diff: float = 0.0, max_p: float = 1.0, max_q: float = 1.0, up: bool = False, down: bool = False
):
    """True where a comparison passes. Zero differences pass ``up`` and ``down`` here."""
    diff = F.col("diff")
    good = diff.isNotNull() & (F.abs(diff) >= min_diff) & F.col("pval").isNotNull() & (
        F.col("pval") <= max_p
    )
    if up:
        good = good & (diff >= 0)
    if down:
        good = good & (diff <= 0)
    if max_q < 1:
        good = good & F.col("fdr").isNotNull() & (F.col("fdr") <= max_q)
    return F.coalesce(good, F.lit(False))


def dmr_filter(
    tests: DataFrame,
    min_cpg: int = 1,
    min_passing: int = 1,
    keys: list[str] | None = None,
    **thresholds,
) -> DataFrame:
    """Regions with ``min_cpg`` sites where at least ``min_passing`` comparisons pass,
    with all their comparisons."""
    keys = keys or KEYS
    big = tests.filter(F.col("cpg") >= min_cpg)
    if min_passing <= 0:
        return big
    rows = F.collect_list(F.struct(*[c for c in tests.columns if c not in keys]))
    return (
        big.groupBy(*keys)
        .agg(F.count_if(dmr_pass(**thresholds)).alias("passing"), rows.alias("rows"))
        .filter(F.col("passing") >= min_passing)
        .select(*keys, F.inline("rows"))
    )


def group_means(tests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys,group,mu``: a group's mean averaged over its comparisons."""
    keys = keys or KEYS
    sides = F.array(
        F.struct(F.col("g1").alias("group"), F.col("mu1").alias("mu")),
        F.struct(F.col("g2").alias("group"), F.col("mu2").alias("mu")),
    )
    return tests.select(*keys, F.inline(sides)).groupBy(*keys, "group").agg(F.avg("mu").alias("mu"))


def attach_tests(regions: DataFrame, tests: DataFrame) -> DataFrame:
    """All regions with their test rows, matched on chromosome and start."""
    extra = [c for c in tests.columns if c not in ("end", "cpg")]
    return regions.join(tests.select(*extra), ["chrom", "start"], "left")


def dmrs_wide(
    tests: DataFrame, groups: dict[str, list[str]], keys: list[str] | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """One row per region: ``<group>:mu`` columns, then ``<g1>-><g2>:diff`` and ``:pval``
    (and any ``extra`` statistic) per comparison."""
    keys = keys or KEYS
    means = group_means(tests, keys)
    mus = means.groupBy(*keys).agg(
        *[F.max(F.when(F.col("group") == g, F.col("mu"))).alias(f"{g}:mu") for g in groups]
    )
    cells = []
    for a, b in combinations(groups, 2):
        mine = (F.col("g1") == a) & (F.col("g2") == b)
        for stat in ("diff", "pval", *extra):
            cells.append(F.max(F.when(mine, F.col(stat))).alias(f"{a}->{b}:{stat}"))
    return mus.join(tests.groupBy(*keys).agg(*cells), keys)


def find_dmrs(
    regions: DataFrame,
    groups: dict[str, list[str]],
    min_cpg: int = 1,
    min_passing: int = 1,
    keys: list[str] | None = None,
    prior: str | tuple[float, float] = "learn",
    **thresholds,
) -> DataFrame:
    """Wald tests with ``fdr``, filtered like ``dmr_filter``."""
    tests = bh_fdr(wald_pairs(regions, groups, keys, prior))
    return dmr_filter(tests, min_cpg, min_passing, keys, **thresholds)
