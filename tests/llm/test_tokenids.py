import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from epilane.llm import tokenids
from epilane.session import Scratch

from . import cases

LIBRARY = Tokenizer.from_file(tokenids.WORD_BPE)
CACHE = tokenids.WordCache(tokenids.WORD_BPE, limit=50, most_pieces=20)


def library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, tokenids.END_ID]


def model(documents):
    """(key, start, size, checksum) in order of key, then text; null keys come first."""
    out, at = [], 0
    order = sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    for key, text in order:
        ids = library(text)
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def rows(frame):
    return sorted(
        ((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in frame.collect()),
        key=lambda r: r[1],
    )


def test_whole_table(spark):
    found = entry_point.queries()["op8_token_ids"](spark, cases.FOLDER)
    assert rows(found) == model(cases.texts(spark).items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_words_give_the_ids_of_the_text(texts):
    assert [x.tolist() for x in CACHE.encode(texts, tokenids.END_ID)] == [library(t) for t in texts]


@pytest.mark.parametrize(
    "text",
    ["İstanbul ſ ẞ é é", "'S it''s x''s 'll", "<|endoftext|>Hi<|startoftext|>", "ΑΣ Σ ٣a", "a.b,c!!", "\x1c y\x85z\xa0k"],
)
def test_hard_words(text):
    assert CACHE.encode([text], tokenids.END_ID)[0].tolist() == library(text)


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_lengths_are_best_and_limited():
    random.seed(3)
    for _ in range(40):
        counts = np.array([random.choice([0, 1, 2, 5, 1000, 10**6]) for _ in range(40)])
        used = counts[counts > 0]
        if len(used) < 2:
            continue
        free = tokenids.code_lengths(counts, 32).astype(int)
        assert (free * counts).sum() == huffman_cost(counts.tolist())
        tight = tokenids.code_lengths(counts, 6).astype(int)
        assert tight.max() <= 6 and sum(2.0 ** -x for x in tight[tight > 0]) <= 1
        assert (tight > 0).tolist() == (counts > 0).tolist()


def test_single_id_and_none():
    assert tokenids.code_lengths(np.array([0, 7]), 16).tolist() == [0, 1]
    assert tokenids.code_lengths(np.array([0, 0]), 16).tolist() == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=200), min_size=1, max_size=8))
def test_blocks_round_trip(docs):
    arrays = [np.array(d, "<u4") for d in docs]
    counts = np.bincount(np.concatenate(arrays))
    lengths = tokenids.code_lengths(counts, 16)
    keys = [None if i % 3 == 2 else -i for i in range(len(docs))]
    raw = tokenids.pack_block(4, 9, keys, arrays, lengths, tokenids.canonical_codes(lengths))
    part, first, found_keys, found = tokenids.unpack_block(raw, tokenids.decode_table(lengths))
    assert (part, first, found_keys) == (4, 9, keys)
    assert [x.tolist() for x in found] == docs


def digests(spark, frame, **options):
    with Scratch(spark) as scratch:
        tokens = scratch.table(tokenids.tokenize(frame, chunk_bytes=64), "tokens")
        lengths = tokenids.code_lengths(tokenids.id_counts(tokens), 16)
        blocks = scratch.table(tokenids.write_ids(tokens, f"{scratch.path}/f", lengths, **options), "blocks")
        decoded = tokenids.read_ids(blocks, f"{scratch.path}/f", lengths)
        return scratch.result(tokenids.id_digests(decoded, tokenids.part_starts(blocks)))


def test_awkward_and_empty(spark):
    frame = cases.awkward(spark).repartition(3)
    expected = model([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert rows(digests(spark, frame)) == expected
    assert rows(digests(spark, frame, block_ids=10)) == expected
    assert digests(spark, cases.nothing(spark)).count() == 0


def test_structured_words_are_told_apart():
    texts = list(cases.thue_morse())
    assert [x.tolist() for x in CACHE.encode(texts, tokenids.END_ID)] == [library(t) for t in texts]


def test_one_key_spans_several_parts(spark, monkeypatch):
    rows_ = [(None if i % 2 else 7, f"word{i % 5} " * 80_000) for i in range(60)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string").repartition(6)
    parts = tokenids.tokenize(frame).groupBy("doc_id").agg({"part": "approx_count_distinct"}).collect()
    assert min(r[1] for r in parts) > 1
