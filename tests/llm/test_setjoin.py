import random

import numpy as np

import __spark_entry__ as entry_point
from epilane.llm import setjoin

from . import cases
from .test_neardup import crowd, model, rows


def check(spark, documents, similarity=setjoin.SIMILARITY):
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    expected = sorted(model(documents, round(100 * similarity)), key=str)
    assert rows(setjoin.shingle_join(frame, similarity)) == expected


def test_whole_table(spark):
    found = entry_point.queries()["op12_shingle_join"](spark, cases.FOLDER)
    assert rows(found) == sorted(model(cases.texts(spark).items(), 80), key=str)


def test_crowd_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BUCKET", 4)
    monkeypatch.setattr(setjoin, "TILE", 32)
    check(spark, crowd(n=300))


def test_small_sets_and_structured_words(spark):
    random.seed(2)
    words = "a b c d e f g h".split()
    documents = [(i, " ".join(random.choices(words, k=random.randint(0, 14)))) for i in range(200)]
    for i, x in enumerate(cases.thue_morse()):
        documents.append((1000 + i, " ".join(f"{x}{k}" for k in range(9))))
    check(spark, documents)


def test_similarity_at_the_threshold(spark):
    # 9 of 11 shingles (0.818), 8 of 10 (0.8 exactly), 7 of 9 (0.778).
    base = [f"v{i}" for i in range(40)]
    documents = []
    for k, n in enumerate((14, 13, 12)):
        text = [f"{k}{w}" for w in base[:n]]
        documents += [(10 * k, " ".join(text)), (10 * k + 1, " ".join([*text[:-1], "other"]))]
        documents += [(10 * k + 2, " ".join([*text, "more"]))]
    check(spark, documents)
    check(spark, documents, 0.75)


def test_awkward_and_empty(spark):
    found = setjoin.shingle_join(cases.awkward(spark)).collect()
    component = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found}
    assert len(found) == 14
    assert component[2, 8] == 1 and component[3, 0] == 3 and component[5, 0] == 5
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)
    assert next(r for r in found if r["doc_id"] == 7)["component_id"] == 6
    assert setjoin.shingle_join(cases.nothing(spark)).count() == 0


def test_prefixes_hold_a_shared_shingle():
    random.seed(1)
    for _ in range(300):
        n = random.randint(1, 60)
        a = set(random.sample(range(80), n))
        b = (a - set(random.sample(sorted(a), min(len(a), random.randint(0, 6))))) | set(
            random.sample(range(80), random.randint(0, 6))
        )
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        heads = [sorted(s)[: int(setjoin.prefix_sizes(np.array([len(s)]), 80)[0])] for s in (a, b)]
        assert set(heads[0]) & set(heads[1])
