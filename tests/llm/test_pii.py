import hashlib
import random
import re

import __spark_entry__ as entry_point
from epilane.llm import pii

from . import cases

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def model(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            fine = [
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                10 <= len(digits) <= 15,
            ]
            if fine[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_of_random_strings():
    random.seed(3)
    for _ in range(20_000):
        letters = "0123456789012345678901234567..@@ab-+ ()é\n"
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        assert pii.base_spans(text) == model(text), text


def test_whole_table(spark):
    texts = cases.texts(spark)
    rows = entry_point.queries()["op4_pii"](spark, cases.FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = model(texts[r["doc_id"]])
        counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert [r[f"n_{k}"] for k in pii.KINDS] == counts
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))


SAMPLES = [
    f"Lorem ipsum {p} dolor sit amet {i}."
    for i in range(40)
    for p in ("+1 (987) 555-2485", "joe.b@mail.example.com", "10.0.3.200", "4242 4242 4242 4242")
]


def found(text, weights):
    return [(pii.KINDS[k], text[s:e], base) for s, k, e, base in pii.all_spans(text, weights)]


def test_field_adds_what_the_patterns_miss():
    weights = pii.fit_segments(SAMPLES)
    assert found("call (988) 555-2485 now", weights) == [("phone", "(988) 555-2485", False)]
    assert found("tel 988-555-2485.", weights) == [("phone", "988-555-2485", False)]
    both = "ring +1 (269) 555-3296 4524132264652876 today"
    assert [x[:2] for x in found(both, weights)] == [
        ("phone", "+1 (269) 555-3296"),
        ("card", "4524132264652876"),
    ] or not pii.luhn("4524132264652876")
    text = "write to bob.42 (at) mail8.example.com please"
    assert found(text, weights) == [("email", "bob.42 (at) mail8.example.com", False)]
    for clean in (
        "on 2024-01-02 we paid 1,234.56 for 12 items",
        "password=b7db7aa4a5fcc78305",
        "pages 123-456, 1999-2004",
        "3.14159265 and 42",
        "",
    ):
        assert found(clean, weights) == []


def brute_best(lattice, weights):
    """Best total over all sets of disjoint candidates."""
    scored = [
        (i, j, sum(weights.get(f, 0.0) for f in names)) for i, j, _, names in lattice.candidates
    ]

    def best(at):
        if at >= len(lattice.atoms):
            return 0.0
        here = [s + best(j) for i, j, s in scored if i == at and s > 0]
        return max([best(at + 1), *here])

    return best(0)


def test_dynamic_programming_finds_the_best_segmentation():
    random.seed(8)
    for text in ("+1 (269) 555-3296 1.2.3.4", "a@b.c 12 345-6789 1.2.3.4.5.6.7", "555-1234 555-1234 55"):
        lattice = pii.Lattice(text)
        for _ in range(5):
            weights = {f: random.gauss(0, 2) for c in lattice.candidates for f in c[3]}
            chosen = pii.best_segments(lattice, weights)
            names = {(i, j, k): n for i, j, k, n in lattice.candidates}
            total = sum(sum(weights.get(f, 0.0) for f in names[c]) for c in chosen)
            assert abs(total - brute_best(lattice, weights)) < 1e-9
            assert all(a[1] <= b[0] for a, b in zip(chosen[:-1], chosen[1:], strict=True))


def test_gradient_is_the_slope_of_the_likelihood():
    import math

    lattice = pii.Lattice("x 555-123-4567 1.2.3.4")
    weights = {f: 0.1 * i for i, f in enumerate(sorted({f for c in lattice.candidates for f in c[3]}))}
    gold = {lattice.candidates[-1][:3]}

    def likelihood(w):
        def total(at):
            if at >= len(lattice.atoms):
                return 1.0
            return total(at + 1) + sum(
                math.exp(sum(w.get(f, 0.0) for f in n)) * total(j)
                for i, j, _, n in lattice.candidates
                if i == at
            )

        own = sum(sum(w.get(f, 0.0) for f in n) for *c, n in lattice.candidates if tuple(c) in gold)
        return own - math.log(total(0))

    slope = pii._gradient(lattice, weights, gold)
    for f in list(weights)[:6]:
        up = likelihood({**weights, f: weights[f] + 1e-5}) - likelihood(weights)
        assert abs(up / 1e-5 - slope.get(f, 0.0)) < 1e-3


def test_awkward_and_empty(spark):
    frame = cases.awkward(spark)
    weights = pii.fit_pii(frame)
    assert pii.span_digests(pii.find_pii(frame, weights)).count() == 14
    clean = pii.redact(frame, weights)
    assert clean.columns == frame.columns and clean.count() == 14
    assert sum(r["text"] is None for r in clean.collect()) == 2
    none = cases.nothing(spark)
    assert pii.find_pii(none, pii.fit_pii(none)).count() == 0
    one = spark.createDataFrame([(1, "mail a.b@c.de or +1 (987) 555-2485.", 9)], "doc_id long, text string, n_chars long")
    row = pii.redact(one, weights).first()
    assert row["text"] == "mail <EMAIL> or <PHONE>." and row["n_chars"] == len(row["text"])


ABROAD = [
    f"Lorem ipsum {p} dolor sit amet {i}."
    for i in range(40)
    for p in ("+33 6 12 34 56 78", "+44 20 7946 0958", "+49 30 123 4567")
]


def test_spans_of_many_tokens_are_seen_whole():
    weights = pii.fit_segments(SAMPLES + ABROAD)
    for phone in ("06 12 34 56 78", "0044 20 7946 0958", "33 6 12 34 56 78", "0033 6 12 34 56 78"):
        assert found(f"appel {phone} merci", weights) == [("phone", phone, False)]
    for address in (
        "anna [at] example [dot] org",
        "a.b (at) c (dot) co (dot) uk",
        "anna [at] mail [dot] example [dot] org",
    ):
        assert found(f"write to {address} please", weights) == [("email", address, False)]


def test_stretches_reach_from_the_last_trigger():
    text = "one two three 06 12 34 56 78 four five six seven 9 ten"
    assert [text[a:b] for a, b in pii.stretches(text)] == ["two three 06 12 34 56 78 four five", "six seven 9 ten"]
    assert pii.stretches("1 " * 9_000)[0] == (0, 18_000)
    random.seed(4)
    for _ in range(2_000):
        text = "".join(random.choice("1a@ \n") for _ in range(random.randint(0, 60)))
        cuts = pii.stretches(text)
        assert all(a[1] < b[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        for m in pii.TRIGGER.finditer(text):
            assert any(a <= m.start() and m.end() <= b for a, b in cuts), text
    long = " ".join(f"{i} word" for i in range(1_000))
    parts = pii.sample_pieces(long)
    assert "".join(parts) == long and max(map(len, parts)) <= 400
