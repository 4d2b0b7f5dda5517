import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_point
from epilane.llm import toxicity

from . import cases


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def matched(entries, words):
    matcher = toxicity.Matcher(entries)
    number = {c: i for i, c in enumerate(matcher.letters)}
    letters = np.array([number.get(c, len(number)) for w in words for c in w], np.uint8)
    sizes = np.array([len(w) for w in words])
    entry, error = matcher.run(letters, np.cumsum(sizes) - sizes, sizes)
    return [(int(e), int(k)) if e >= 0 else None for e, k in zip(entry, error, strict=True)]


def test_automaton_finds_what_edit_distance_finds():
    random.seed(6)
    entries = [
        toxicity.Entry(w, toxicity.TOXIC, 1.0, False, 1) for w in ("abcde", "abbae", "ddcba")
    ] + [toxicity.Entry("bad", toxicity.TOXIC, 1.0, False, 0)]
    words = ["".join(random.choice("abcdx") for _ in range(random.randint(1, 7))) for _ in range(3000)]
    words += ["abcde", "bad", "bed", "abcdef", "bcde"]
    for word, hit in zip(words, matched(entries, words), strict=True):
        near = [(distance(word, e.text), i) for i, e in enumerate(entries)]
        near = [(d, i) for d, i in near if d <= entries[i].errors]
        assert (hit is None) == (not near), word
        if hit:
            assert hit[1] == min(near)[0] and (hit[1], hit[0]) in near


def test_stems_match_prefixes():
    entries = [
        toxicity.Entry("vequ", toxicity.TOXIC, 1.0, True, 0),
        toxicity.Entry("lowei", toxicity.TOXIC, 1.0, True, 1),
    ]
    found = matched(entries, ["vequ", "vequichen", "vexu", "loweich", "lovei", "loxeischaft", "low"])
    assert [x and x[0] for x in found] == [0, 0, None, 1, 1, 1, None]


def fitted(spark, n=400):
    random.seed(11)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ban", "dor", "fil", "gon", "nes")]
    rows, labels = [], []
    for i in range(n):
        words = random.choices(plain, k=60)
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[random.randrange(60)] = random.choice(["stinker", "rotface"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.fit_toxicity(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def scores(model, texts):
    return toxicity.Scorer(model, toxicity.Matcher(model.entries)).scores(texts)


def test_learned_terms_spelling_and_context(spark):
    model = fitted(spark)
    terms = {e.text for e in model.entries if e.kind == toxicity.TOXIC}
    assert terms == {"stinker", "rotface"}
    clean, plain, misspelt, quoted = scores(
        model,
        [
            "kaban lodor mifil",
            "kaban you stinker lodor rotface",
            "kaban you st1nker lodor r0tface",
            'kaban he said "stinker" lodor and wrote "rotface" mifil',
        ],
    )
    assert clean < 0.5 < plain and clean < misspelt <= plain and quoted < plain


def test_whole_table(spark):
    rows = entry_point.queries()["op3_toxicity"](spark, cases.FOLDER).collect()
    texts = cases.texts(spark)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = entry_point.queries()["op3_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    caught = sum(r["predicted"] for r in rows if r["toxic"])
    assert right / len(rows) > 0.95  # a share of junk carries labels at random
    assert caught / sum(r["toxic"] for r in rows) > 0.75


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    documents = cases.documents(spark)
    labels = spark.read.parquet(f"{cases.FOLDER}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn(
        "toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a, b = (toxicity.fit_toxicity(documents, x) for x in (labels, turned))
    assert a.bias == b.bias and a.weights.tolist() == b.weights.tolist() and a.entries == b.entries


def test_awkward_and_empty(spark):
    frame, none = cases.awkward(spark), cases.nothing(spark)
    labels = spark.createDataFrame([(1, None, 1), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        model = toxicity.fit_toxicity(frame, lab)
        rows = toxicity.score_toxicity(frame, model).collect()
        assert len(rows) == 14 and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.drop_toxic(frame, model).columns == frame.columns
        assert toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.drop_toxic(frame, toxicity.fit_toxicity(none, labels)).count() == 14


def test_drop_leaves_clean_rows(spark):
    model = fitted(spark)
    frame = spark.createDataFrame(
        [(1, "kaban you stinker", 5), (2, "kaban", 6), (3, None, 7)], "doc_id long, text string, score int"
    )
    assert sorted(r["score"] for r in toxicity.drop_toxic(frame, model).collect()) == [6, 7]
