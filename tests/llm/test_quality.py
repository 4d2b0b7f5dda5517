import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from epilane.llm import quality

from . import cases


def test_whole_table_separates_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = entry_point.queries()["op5_site_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").collect()
    assert found.count() == 1000
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.93


def test_rates_are_those_of_the_formula(spark):
    frame = entry_point.queries()["op5_site_quality"](spark, cases.FOLDER)
    documents = cases.documents(spark).select("doc_id", "source", "lang")
    rows = [r.asDict() for r in frame.join(documents, "doc_id").collect()]
    rate = np.mean([r["evidence"] for r in rows])

    def groups(keys):
        out = {}
        for r in rows:
            out.setdefault(tuple(r[k] for k in keys), []).append(r["evidence"])
        return out

    def pull(found):
        n = np.array([len(v) for v in found.values()], float)
        r = np.array([np.mean(v) for v in found.values()])
        chance = rate * (1 - rate)
        spare = n.sum() - (n**2).sum() / n.sum()
        beyond = ((n * (r - rate) ** 2).sum() - len(n) * chance) / spare
        return min(max(chance / beyond - 1, 1.0), 1e4) if beyond > 0 else 1e4

    sites, sections = groups(["source"]), groups(["source", "lang"])
    for r in rows:
        site, section = sites[r["source"],], sections[r["source"], r["lang"]]
        own = r["evidence"]
        at_site = (sum(site) - own + pull(sites) * rate) / (len(site) - 1 + pull(sites))
        at_section = (sum(section) - own + pull(sections) * at_site) / (
            len(section) - 1 + pull(sections)
        )
        assert abs(r["site_rate"] - at_site) < 1e-6
        assert abs(r["section_rate"] - at_section) < 1e-6


def test_a_bad_site_weighs_on_its_documents(spark):
    good = "the cat and the dog went to the house with a friend in the morning number {}."
    bad = "## $$ %% || ## $$ ## {} ## $$"
    rows, labels = [], []
    for i in range(240):
        site = "spam" if i % 3 == 0 else f"site{i % 5}"
        text = (bad if site == "spam" and i % 12 else good).format(i * 7919)
        rows.append((i, text, "en", site))
        labels.append((i, int(site != "spam"), 0))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = quality.site_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[0]["section_rate"] < by_id[1]["section_rate"]
    assert by_id[0]["score"] < by_id[1]["score"]  # the same kind of text


def test_levels_of_an_address(spark):
    urls = ["https://Shop.example.com/en/x?q=1", "http://a.b", "nonsense", None]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    host, path = quality.url_levels(F.col("u"))
    assert [tuple(r) for r in frame.select(host, path).collect()] == [
        ("shop.example.com", "en"),
        ("a.b", None),
        (None, None),
        (None, None),
    ]


def test_awkward_and_empty(spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (3, 0, 0), (6, 1, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int"
    )
    for lab in (labels, labels.limit(0)):
        rows = quality.site_quality(cases.awkward(spark), lab).collect()
        assert len(rows) == 14
        assert all(0 <= r["score"] <= 1 and 0 < r["section_rate"] < 1 for r in rows)
    assert quality.site_quality(cases.nothing(spark), labels).count() == 0
