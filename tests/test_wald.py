import math
import random

import pytest
from pyspark.sql import functions as F

from epilane.operators import wald


def test_bh_matches_the_definition(spark):
    rng = random.Random(8)
    rows = []
    for pair in ("x", "y"):
        ps = [rng.choice([0.0, 1.0, 1e-9, rng.random(), round(rng.random(), 1)]) for _ in range(80)]
        rows += [(pair, "z", i, p) for i, p in enumerate(ps)] + [(pair, "z", 99, None)]
    df = spark.createDataFrame(rows, "g1 string, g2 string, id long, pval double")
    got = {(r["g1"], r["id"]): r["fdr"] for r in wald.bh_fdr(df).collect()}
    for pair in ("x", "y"):
        ps = sorted(((p, i) for g, _, i, p in rows if g == pair and p is not None), reverse=True)
        low, m = 1.0, len(ps)
        for k, (p, i) in enumerate(ps):
            low = min(low, p * m / (m - k))
            # Equal p-values share the value of the last of them.
            last = min(
                [low] + [q * m / (m - j) for j, (q, _) in enumerate(ps) if q == p]
            )
            assert got[(pair, i)] == pytest.approx(last, abs=1e-12)
        assert got[(pair, 99)] is None


def log_posterior(log_phi, samples, mu, mean, sd):
    size = math.exp(-log_phi) - 1
    a, b = mu * size, (1 - mu) * size
    fit = 0.0
    for n, x in samples:
        fit += math.lgamma(x + a) + math.lgamma(n - x + b) - math.lgamma(n + a + b)
        fit += math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return fit - (log_phi - mean) ** 2 / (2 * sd**2)


def test_dispersion_is_the_posterior_mode(spark):
    samples = [(40, 10), (60, 33), (25, 5)]
    mu = (48 + 0.5) / (125 + 1)
    df = spark.createDataFrame(
        [([float(n) for n, _ in samples], [float(x) for _, x in samples], mu, -3.0, 1.0)],
        "n array<double>, x array<double>, mu double, m double, s double",
    )
    phi = df.select(wald.shrunken_dispersion("n", "x", "mu", "m", "s", *(F.lit(v) for v in wald.LOG_RANGE)).alias("phi")).first()["phi"]
    low, high = wald.LOG_RANGE
    grid = [low + (high - low) * k / 20000 for k in range(20001)]
    best = max(grid, key=lambda v: log_posterior(v, samples, mu, -3.0, 1.0))
    assert math.log(phi) == pytest.approx(best, abs=5e-4)


def region_rows(spark, values):
    rows = [("c", s, s + 9, 3, name, n, x) for s, name, n, x in values]
    return spark.createDataFrame(rows, "chrom string, start long, end long, cpg long, sample string, n long, x long")


def test_wald_statistic(spark):
    df = region_rows(spark, [(1, "a", 40, 10), (1, "b", 60, 12), (1, "c", 50, 40), (1, "d", 30, 25)])
    row = wald.wald_pairs(df, {"g1": ["a", "b"], "g2": ["c", "d"]}, prior=(-3.0, 1.0)).first()
    mu = [(22.5) / 101, 65.5 / 81]
    assert (row["mu1"], row["mu2"]) == (pytest.approx(mu[0]), pytest.approx(mu[1]))
    var = 0.0
    low, high = wald.LOG_RANGE
    grid = [low + (high - low) * k / 4000 for k in range(4001)]
    for m, samples in zip(mu, ([(40, 10), (60, 12)], [(50, 40), (30, 25)])):
        phi = math.exp(max(grid, key=lambda v: log_posterior(v, samples, m, -3.0, 1.0)))
        total = sum(n for n, _ in samples)
        var += sum(n * m * (1 - m) * (1 + (n - 1) * phi) for n, _ in samples) / total**2
    stat = (mu[1] - mu[0]) / math.sqrt(var)
    assert row["stat"] == pytest.approx(stat, rel=1e-3)
    assert row["pval"] == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)), rel=1e-2)


def test_groups_without_replicates_share_a_dispersion(spark):
    df = region_rows(spark, [(1, "a", 40, 10), (1, "c", 50, 40), (1, "d", 30, 25)])
    rows = wald.wald_pairs(df, {"g1": ["a"], "g2": ["c", "d"], "g3": ["zz"]}, prior=(-3.0, 1.0)).collect()
    assert [(r["g1"], r["g2"]) for r in rows] == [("g1", "g2")]
    assert rows[0]["diff"] > 0.4 and rows[0]["pval"] < 0.05


def test_threshold_counts_and_wide_table(spark):
    rows = [
        ("c", 1, 9, 3, "g1", "g2", 0.1, 0.4, 0.3, 0.01),
        ("c", 1, 9, 3, "g1", "g3", 0.2, 0.2, 0.0, 0.01),
        ("c", 1, 9, 3, "g2", "g3", 0.4, 0.2, -0.2, 0.2),
        ("c", 20, 29, 1, "g1", "g2", 0.1, 0.4, 0.3, 0.01),
    ]
    tests = spark.createDataFrame(
        rows,
        "chrom string, start long, end long, cpg long, g1 string, g2 string, mu1 double, mu2 double, diff double, pval double",
    )

    def kept(**more):
        return wald.dmr_filter(tests, **more).count()

    assert kept(min_passing=0) == 4
    assert kept(min_cpg=2, min_passing=3) == 3
    assert kept(min_cpg=2, min_passing=2, max_p=0.05) == 3
    assert kept(min_cpg=2, min_passing=2, max_p=0.05, up=True) == 3
    assert kept(min_cpg=2, min_passing=2, max_p=0.05, min_diff=0.1) == 0
    wide = wald.dmrs_wide(tests, {"g1": [], "g2": [], "g3": []}).filter("start = 1").first()
    assert wide["g1:mu"] == pytest.approx(0.15) and wide["g2->g3:diff"] == -0.2
    assert wide["g1->g2:pval"] == 0.01
