import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from epilane.llm import bpe

from . import cases

LIBRARY = Tokenizer.from_file(bpe.BYTE_BPE)
ENCODER = bpe.Encoder(bpe.BYTE_BPE)


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, "<u4").tobytes()
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_merges_come_after_their_parts():
    rank = {int(m): i for i, m in enumerate(ENCODER.vocabulary.made)}
    for i, (a, b) in enumerate(zip(ENCODER.vocabulary.left, ENCODER.vocabulary.right, strict=True)):
        assert rank.get(int(a), -1) < i and rank.get(int(b), -1) < i


def test_whole_table(spark):
    rows = entry_point.queries()["op9_bpe"](spark, cases.FOLDER).collect()
    texts = cases.texts(spark)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == library(texts[r["doc_id"]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    found = ENCODER.encode(texts)
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert bpe.decode_ids(ids, ENCODER.vocabulary).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ", max_size=80))
def test_runs_of_equal_letters(text):
    assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_awkward_and_empty(spark):
    frame = cases.awkward(spark)
    rows = bpe.bpe_decode(bpe.bpe_encode(frame, chunk_bytes=50), chunk_bytes=50).collect()
    assert len(rows) == 14
    for r in rows:
        assert r["decoded"] == (r["text"] or "")
        assert len(r["ids"]) == 4 * r["n_tokens"]
    assert bpe.bpe_digests(cases.nothing(spark)).count() == 0
