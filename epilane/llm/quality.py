"""Quality by a document classifier and empirical-Bayes rates of site and section.

A logistic classifier on text counts gives each document evidence of its own. Sites
(hosts) and sections (paths within them) get rates by grouped sums of that evidence: a
section's rate is drawn towards its site's, a site's towards the rate of all documents,
with strengths estimated from how much the rates vary beyond chance. A second logistic
fit weighs evidence against the section's rate. A document's own part is taken out of the
sums before they speak about it.

Cases: a null text counts as empty; a null site or section has no rate of its own and
takes that of the level above; a null key is kept and does not train; repeated rows count
as rows; without labels of both kinds the score is 0.5 for all; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.llm.rules import CHAR_BINS, text_counts
from epilane.session import Scratch

FOLDS = 5
SHARES = [b for b in CHAR_BINS if b != "other"]
FEATURES = ["size", "length", "symbols", "dup_lines", "repeats", "common", *SHARES]
LEAST = 1e-4


def url_levels(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address, for use as site and section."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)
    return F.nullif(host, F.lit("")), F.nullif(path, F.lit(""))


def evidence_features(counts: DataFrame) -> DataFrame:
    """Bounded features of the counts of ``rules.text_counts``."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("chars_total"), F.lit(1)).cast("double")
    uncommon = F.element_at("common", -1)
    columns = {
        "size": F.least(F.log1p(F.col("n_words").cast("double")), F.lit(7.0)),
        "length": F.least(F.col("word_chars") / words, F.lit(20.0)),
        "symbols": F.least(F.col("n_symbols") / words, F.lit(2.0)),
        "dup_lines": F.least(10 * F.col("n_dup_lines") / words, F.lit(2.0)),
        "repeats": F.col("n_repeat_words") / words,
        "common": 1 - uncommon / words,
        **{
            b: F.get("chars", F.lit(CHAR_BINS.index(b))) / chars for b in SHARES
        },
    }
    return counts.withColumns({f"x_{k}": v.cast("double") for k, v in columns.items()})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60):
    """Weights and bias on the given scale; columns are standardised for the ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    pull = np.concatenate([np.full(x.shape[1], ridge), [1e-6]])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + pull * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def _linear(names: list[str], weights, bias: float) -> Column:
    total = F.lit(float(bias))
    for name, w in zip(names, weights, strict=True):
        total = total + F.lit(float(w)) * F.col(name)
    return F.greatest(F.least(total, F.lit(12.0)), F.lit(-12.0))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - LEAST)), F.lit(LEAST))
    return F.log(p / (1 - p))


def group_rates(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sum and number of ``evidence`` per group; groups with a null key are left out."""
    known = rows
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(
        F.sum("evidence").alias(f"sum_{name}"), F.count("*").alias(f"n_{name}")
    )


def strength(groups: DataFrame, name: str, rate: float, low: float = 1.0, high: float = 1e4) -> float:
    """How many documents the level above is worth, by the method of moments.

    Rates of groups vary by chance (rate * (1 - rate) / n) and beyond; the less beyond,
    the stronger the pull.
    """
    n = F.col(f"n_{name}")
    r = F.col(f"sum_{name}") / n
    row = groups.agg(
        F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(n * (r - rate) ** 2).alias("s"),
        F.count("*").alias("k"),
    ).first()
    if not row["k"] or row["k"] < 2:
        return high
    chance = rate * (1 - rate)
    beyond = (row["s"] - row["k"] * chance) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(min(max(chance / beyond - 1, low), high)) if beyond > 0 else high


def site_quality(
    documents: DataFrame,
    labels: DataFrame,
    site_col: str = "source",
    section_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """Evidence, rates and combined score per document; ``kept`` from ``threshold`` on.

    Labels of documents whose key hash falls in one fold of five never train. To the
    driver come at most about ``max_train`` rows of numbers, twice, and a few totals.
    """
    with Scratch(documents.sparkSession) as scratch:
        base = documents.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(text_col).cast("string").alias("text"),
            F.to_json(F.struct(F.col(site_col).alias("s"), F.col(section_col).alias("p"))).alias("lang"),
        )
        # The counts carry one more column; both levels travel in it.
        counts = evidence_features(text_counts(base, None, "id", "text", "lang")).select(
            "id",
            F.get_json_object("lang", "$.s").alias("site"),
            F.get_json_object("lang", "$.p").alias("section"),
            *(f"x_{f}" for f in FEATURES),
        )
        rows = scratch.table(counts, "features")
        usable = labels.filter("quality is not null and doc_id is not null").select(
            F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")
        )
        usable = usable.filter(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(FOLDS)) != 0)
        n = usable.count()
        if n > max_train:
            share = int(max_train / n * (1 << 30))
            usable = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
        sample = F.broadcast(usable)  # at most about max_train rows of two numbers
        names = [f"x_{f}" for f in FEATURES]
        train = rows.join(sample, "id").select("quality", *names).toPandas()
        if train["quality"].nunique() < 2:
            weights, bias = np.zeros(len(names)), 0.0
        else:
            weights, bias = fit_logistic(train[names].to_numpy(), train["quality"].to_numpy(float))
        own = _linear(names, weights, bias)
        judged = rows.select("id", "site", "section", own.alias("logit")).withColumn(
            "evidence", 1 / (1 + F.exp(-F.col("logit")))
        )
        judged = scratch.table(judged, "evidence")
        total = judged.agg(F.avg("evidence")).first()[0]
        rate = min(max(total if total is not None else 0.5, LEAST), 1 - LEAST)
        sites = scratch.table(group_rates(judged, ["site"], "site"), "sites")
        sections = scratch.table(group_rates(judged, ["site", "section"], "section"), "sections")
        pull_site, pull_section = strength(sites, "site", rate), strength(sections, "section", rate)
        joined = judged.join(sites, "site", "left").join(sections, ["site", "section"], "left")

        def level(name, above, pull):
            rest = F.col(f"sum_{name}") - F.col("evidence")
            many = F.col(f"n_{name}") - 1
            return F.coalesce((rest + pull * above) / (many + pull), above)

        joined = joined.withColumn("site_rate", level("site", F.lit(rate), pull_site))
        joined = joined.withColumn("section_rate", level("section", F.col("site_rate"), pull_section))
        joined = joined.withColumn(
            "lift", _logit(F.col("section_rate")) - F.lit(float(np.log(rate / (1 - rate))))
        ).select("id", "logit", "evidence", "site_rate", "section_rate", "lift")
        joined = scratch.table(joined, "rates")
        second = joined.join(sample, "id").select("quality", "logit", "lift").toPandas()
        if second["quality"].nunique() < 2:
            final = F.lit(0.0) * F.col("logit")
        else:
            w, b = fit_logistic(
                second[["logit", "lift"]].to_numpy(), second["quality"].to_numpy(float)
            )
            final = _linear(["logit", "lift"], w, b)
        return scratch.result(
            joined.withColumn("score", 1 / (1 + F.exp(-final))).select(
                F.col("id").alias(id_col),
                "evidence",
                "site_rate",
                "section_rate",
                "score",
                (F.col("score") >= threshold).alias("kept"),
            )
        )


def op5_site_quality(spark, folder):
    return site_quality(
        spark.read.parquet(f"{folder}/documents.parquet"),
        spark.read.parquet(f"{folder}/labels.parquet"),
    )
