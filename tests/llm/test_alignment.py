import hashlib
import random

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from epilane.llm import alignment, bpe

from . import cases

A = Tokenizer.from_file(alignment.A_FILE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
LETTERS = {c: b for b, c in enumerate(bpe.byte_letters())}


def sides(text):
    """Groups of a text, by going through both lists token by token."""
    if not text:
        return []
    wanted = b" " + text.encode()
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != wanted or b"".join(x for _, x in b) != wanted:
        return []
    groups, at_b, end_a, end_b = [], 0, 0, 0
    left, right = [], []
    for i, raw in a:
        left.append(i)
        end_a += len(raw)
        while end_b < end_a:
            right.append(b[at_b][0])
            end_b += len(b[at_b][1])
            at_b += 1
        if end_a == end_b:
            groups.append((left, right))
            left, right = [], []
    return groups


def model(documents):
    held = [(k, sides(t)) for k, t in documents]
    counts = {}
    for _, groups in held:
        for pair in {(a, b) for x, y in groups for a in x for b in y}:
            counts[pair] = counts.get(pair, 0) + 1
    most = {}
    for (a, _), c in counts.items():
        most[a] = max(most.get(a, 0), c)
    out = []
    for key, groups in held:
        links = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                str(key),
                sum(len(x) for x, _ in groups),
                sum(len(y) for _, y in groups),
                len(groups),
                len(links),
                sum(counts[p] == most[p[0]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(out), counts, most


def rows(frame):
    columns = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in frame.collect())


def test_whole_table(spark):
    found = entry_point.queries()["op11_token_alignment"](spark, cases.FOLDER)
    assert rows(found) == model(cases.texts(spark).items())[0]


def hard_texts():
    random.seed(3)
    out = ["日本語のテキスト" * 30, "▁ under", "<s> <|endoftext|> </s>", "a  b\n\n\tc ", " x\u0085y", "é\x00ﬁ", "x" * 3000]
    out += ["".join(random.choice("ab é日\n ,1😀") for _ in range(random.randint(1, 60))) for _ in range(80)]
    return out + ["ѣ" * 500 + "日" * 400, "क्षि" * 200]


def test_hard_texts_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "WHOLE_GROUP", 8)
    documents = list(enumerate(hard_texts()))
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    expected, counts, most = model(documents)
    assert rows(alignment.align_documents(frame, run_bytes=300)) == expected
    pairs = alignment.linked_pairs(frame, run_bytes=300).collect()
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in pairs} == counts
    assert all(r["is_best"] == (r["n_docs"] == most[r["a_id"]]) for r in pairs)


def test_both_ways_of_side_a_agree(spark):
    texts = [*hard_texts(), "  two  spaces   and\t\ttabs \n", " " * 50, "It's 12% of £3, they’ll—say", "Größe ñandú ſ ĳ ŉ"]
    fast, plain = alignment.SideA(alignment.A_FILE, alignment.A_RANKS), alignment.SideA(alignment.A_FILE, None)
    assert [x.tolist() for x in fast.encode(texts)] == [x.tolist() for x in plain.encode(texts)]


def test_awkward_and_empty(spark):
    frame = cases.awkward(spark)
    documents = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert rows(alignment.align_documents(frame)) == model(documents)[0]
    assert alignment.align_documents(cases.nothing(spark)).collect() == []
    assert alignment.linked_pairs(cases.nothing(spark)).collect() == []


def test_heap_merge_sums_sorted_runs(monkeypatch):
    monkeypatch.setattr(alignment, "HEAP_BLOCK", 3)
    rng = np.random.default_rng(2)
    for _ in range(50):
        runs = []
        for _ in range(rng.integers(1, 6)):
            keys = np.unique(rng.integers(0, 40, rng.integers(1, 25)))
            runs.append((keys, rng.integers(1, 9, len(keys))))
        expected = {}
        for keys, counts in runs:
            for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                expected[k] = expected.get(k, 0) + c
        pieces = list(alignment.heap_merge(runs))
        keys = np.concatenate([p for p, _ in pieces]).tolist()
        assert keys == sorted(expected)
        assert dict(zip(keys, np.concatenate([c for _, c in pieces]).tolist(), strict=True)) == expected
