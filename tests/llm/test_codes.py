import math
import random

import numpy as np

from epilane.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def model(rows, parts, entries, rounds):
    """Plain search of every entry; rows are (key, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(256 * np.float32(x).item()) for x in v] for _, v, _ in kept]
    size = -(-max(map(len, whole)) // parts) * parts
    whole = [v + [0] * (size - len(v)) for v in whole]
    width = size // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [
            [min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)]
            for v in cut
        ]

    for _ in range(rounds):
        had = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, h in zip(cut, had, strict=True) if h[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    had = assign()
    errors = [sum(far(v[p], books[p][h[p]]) for p in range(parts)) for v, h in zip(cut, had, strict=True)]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    return sorted(
        (str(k), "".join(f"{c:02x}" for c in h), e, labels[label])
        for (k, _, label), h, e in zip(kept, had, errors, strict=True)
    )


def check(spark, rows, parts=4, entries=8, rounds=2):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = codes.compress_vectors(frame, parts, entries, rounds).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in found) == model(
        rows, parts, entries, rounds
    )
    assert len({r["codebooks_sha256"] for r in found}) == 1


def test_random_vectors_with_ties(spark):
    random.seed(4)
    rows = [(i, [random.choice([-2, -1, 0, 1, 2]) / 64 for _ in range(8)], i % 3) for i in range(300)]
    check(spark, rows, entries=12, rounds=3)


def test_clusters(spark):
    random.seed(5)
    centres = [[random.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [
        (i, [x + random.gauss(0, 0.05) for x in random.choice(centres)], random.choice([None, 1, 2]))
        for i in range(400)
    ]
    check(spark, rows, rounds=4)


def test_awkward_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.25, 1.0, 2.0, 3.0], 1),
        (1, [0.5, -0.25, 1.0, 2.0, 3.0], 1),
        (1, [0.25, 0.0], None),
        (2, None, 1),
        (3, [nan, 1.0], 1),
        (4, [inf, 1.0], 1),
        (5, [None, 1.0], 2),
        (6, [], 2),
        (None, [1.0, 1.0, 1.0], None),
    ]
    check(spark, rows, entries=3)
    nothing = spark.createDataFrame([], SCHEMA)
    assert codes.compress_vectors(nothing).collect() == []
    assert codes.compress_vectors(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).count() == 0


def test_rings_leave_out_work_but_no_answer():
    random = np.random.default_rng(1)
    book = random.integers(-50, 50, (32, 3))
    x = random.integers(-60, 60, (2000, 3))
    had = random.integers(0, 32, 2000)
    far = ((x - book[had]) ** 2).sum(1)
    radii = np.full((1, 32), -1)
    np.maximum.at(radii[0], had, far)
    near = codes.neighbours(book[None], radii)
    best, distance = codes.nearest_in_rings(x, had, book, near.squared[0], near.index[0])
    plain, least = codes.nearest_of_all(x, book)
    assert (best == plain).all() and (distance == least).all()
