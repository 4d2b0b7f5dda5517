import hashlib
import random

import __spark_entry__ as entry_point
from epilane.llm import repeats

from . import cases


def model(texts, length=repeats.LENGTH):
    """(bytes, removed, runs, digest) of each text, by counting every string."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows(frame):
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect()),
        key=str,
    )


def test_cover_meets_every_pair_of_residues():
    met = {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}
    assert met == set(range(repeats.PERIOD))


def test_whole_table(spark):
    found = rows(entry_point.queries()["op2_suffix_dedup"](spark, cases.FOLDER))
    texts = cases.texts(spark)
    expected = [(k, *m) for k, m in zip(texts, model(texts.values()), strict=True)]
    assert found == sorted(expected, key=str)


def test_planted_repeats(spark):
    random.seed(5)

    def noise(n):
        return "".join(random.choice("abcdefgh ") for _ in range(n))

    passage, edge = noise(1500), noise(399)
    texts = [
        noise(37) + passage + noise(50),
        noise(900) + passage[200:620] + noise(11) + passage[:401],
        passage[:700] + "#" + passage[700:],
        edge + noise(200) + edge,
        "x" * 1000,
        noise(400) * 2,
        "ñ" * 300,
        noise(10) + passage[900:1300] + "é" + passage[100:520],
        None,
        "",
        noise(400),
    ]
    texts += [texts[0], texts[4]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    expected = sorted(((i, *m) for i, m in enumerate(model(texts))), key=str)
    assert rows(repeats.remove_repeats(frame)) == expected
    assert rows(repeats.remove_repeats(frame, block_bytes=100)) == expected


def test_awkward_and_empty(spark):
    frame = cases.awkward(spark)
    texts = [(r["doc_id"], r["text"]) for r in frame.collect()]
    expected = [(k, *m) for (k, _), m in zip(texts, model([t for _, t in texts]), strict=True)]
    assert rows(repeats.remove_repeats(frame)) == sorted(expected, key=str)
    assert repeats.remove_repeats(cases.nothing(spark)).count() == 0
