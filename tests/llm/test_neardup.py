import hashlib
import itertools
import random

import numpy as np

import __spark_entry__ as entry_point
from epilane.llm import neardup

from . import cases


def model(documents, per_cent=75):
    """(key, shingles, component) by comparing all pairs."""
    sets = [(k, cases.shingles(t or "")) for k, t in documents]
    parent = {k: k for k, _ in sets if k is not None}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    held = [(k, s) for k, s in sets if k is not None and s]
    for (a, x), (b, y) in itertools.combinations(held, 2):
        if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and find(a) != find(b):
            common = len(x & y)
            if 100 * common >= per_cent * (len(x) + len(y) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return [(k, len(s), None if k is None else find(k) if s else k) for k, s in sets]


def rows(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=str)


def test_whole_table(spark):
    found = entry_point.queries()["op6_near_dup"](spark, cases.FOLDER)
    assert rows(found) == sorted(model(cases.texts(spark).items()), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def crowd(n=420, words=60, seed=9):
    """Copies of one text with a few words changed, some of them too many, and chains."""
    random.seed(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3, 4])):
            text[random.randrange(words)] = f"c{random.randrange(10**6)}"
        out.append((i, " ".join(text)))
    chain = [f"k{i}" for i in range(80)]
    for i in range(12):
        chain = [*chain[3:], *(f"m{i}{j}" for j in range(3))]
        out.append((1000 + i, " ".join(chain)))
    return out


def test_crowd_of_near_copies_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_PAIRS", 4)
    monkeypatch.setattr(neardup, "TILE", 64)
    documents = crowd()
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    assert rows(neardup.near_duplicates(frame)) == sorted(model(documents), key=str)


def test_small_sets(spark):
    random.seed(2)
    words = "a b c d e f g h".split()
    documents = [
        (i, " ".join(random.choices(words, k=random.randint(0, 14)))) for i in range(300)
    ]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    assert rows(neardup.near_duplicates(frame)) == sorted(model(documents), key=str)


def test_awkward_and_empty(spark):
    frame = cases.awkward(spark)
    found = neardup.near_duplicates(frame).collect()
    component = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found}
    assert len(found) == 14
    assert component[2, 8] == 1 and component[3, 0] == 3 and component[5, 0] == 5
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)
    assert next(r for r in found if r["doc_id"] == 7)["component_id"] == 6
    assert neardup.near_duplicates(cases.nothing(spark)).count() == 0


def test_drop_keeps_one_row_of_each_group(spark):
    frame = cases.awkward(spark)
    kept = neardup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    keys = sorted((str(r["doc_id"]) for r in kept.collect()))
    assert keys.count("1") == 1 and "2" not in keys and "7" not in keys
    assert keys.count("None") == 2 and {"3", "4", "5", "6", "9", "10"} <= set(keys)
    assert neardup.drop_near_duplicates(cases.nothing(spark)).count() == 0


def test_estimate_is_close_and_collisions_are_taken_off():
    random = np.random.default_rng(1)
    shared, a, b = (random.integers(0, 1 << 62, n).astype(np.uint64) for n in (600, 100, 100))
    owners = np.repeat([0, 1], 700)
    hashes = np.concatenate([shared, a, shared, b])
    row = neardup.registers(hashes, owners, 2, neardup.LARGE_HASHES)
    width = neardup.REGISTERS // neardup.LARGE_HASHES
    assert abs(neardup.estimate(row[:1], row[1:], [700], [700], width)[0] - 0.75) < 0.2
    apart = neardup.registers(
        random.integers(0, 1 << 62, 1400).astype(np.uint64), owners, 2, neardup.LARGE_HASHES
    )
    assert abs(neardup.estimate(apart[:1], apart[1:], [700], [700], width)[0]) < 0.05


def test_every_text_of_a_repeated_key_takes_part(spark):
    first = "one text of ten words that stands under several keys"
    texts = sorted([first, "another text that is quite unlike that one in all words"], key=lambda t: hashlib.md5(t.encode()).digest())
    a, b = texts
    c = " ".join(f"w{i}" for i in range(60))
    near = [" ".join([*(f"w{i}" for i in range(60)), f"x{k}"]) for k in range(3)]
    documents = [(5, a), (5, b), (7, b), (9, b), (20, c), (21, near[0]), (21, near[1]), (30, near[2]), (40, "x")]
    documents += [(50, f"p{i} q{i} r{i} s{i} t{i}") for i in range(50)] + [(60 + i, f"p{i} q{i} r{i} s{i} t{i}") for i in range(50)]
    documents += [(200, near_b) for near_b in (f"{'v ' * 3}{' '.join(f'u{i}' for i in range(60))} {e}" for e in "yz")]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    found = neardup.near_duplicates(frame).collect()
    component = {(r["doc_id"], bytes(r["text_key"])): (r["component_id"], r["kept"]) for r in found}

    def of(key, text):
        return component[key, hashlib.md5(text.encode()).digest()]

    assert of(5, a) == (5, True)
    assert of(5, b) == (5, True) and of(7, b) == of(9, b) == (5, False)
    assert of(20, c) == (20, True)
    assert of(21, near[0]) == of(21, near[1]) == of(30, near[2]) == (20, False)
    for i in range(50):
        text = f"p{i} q{i} r{i} s{i} t{i}"
        assert of(50, text) == (50, True) and of(60 + i, text) == (50, False)
    assert sorted(kept for (k, _), (_, kept) in component.items() if k == 200) == [False, True]
    assert sum(r["doc_id"] == 200 for r in neardup.drop_near_duplicates(frame).collect()) == 1


def test_structured_words_are_told_apart(spark):
    a, b = cases.thue_morse()
    documents = [(i, " ".join(x if k == i else f"{x}{k}" for k in range(8))) for i, x in ((1, a), (2, b))]
    documents += [(3, a), (4, b), (5, a)]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    assert rows(neardup.near_duplicates(frame)) == sorted(model(documents), key=str)
