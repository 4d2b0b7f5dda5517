"""Byte-level BPE: encode and decode whole texts by an index of pair occurrences.

Encoding a chunk of a partition: its distinct pre-tokens lie one after the other as
symbols in a linked list. An index maps each pair with a rank to all its places. Ranks are
taken in ascending order; a merge touches all places of its pair at once and adds the
pairs it makes to their lists. A pair made by a merge always ranks after it, so this
order gives what merging word by word gives.

The vocabulary is a public tokenizer file (JSON of the ``tokenizers`` library), read by
path and never copied.

Cases: a null text is an empty one and has no ids; strings of added tokens become their
ids; null keys, repeated rows and other columns pass through; an empty table gives an
empty result. Memory per task is bounded by ``chunk_bytes`` and the longest text.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epilane.llm.words import release

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
# White space beyond ASCII, and the pre-tokenizer's pattern.
WIDE_SPACE = "".join(
    map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
SPACE = r"\t-\r " + WIDE_SPACE
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and added tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(max(ids.values()), *self.added.values(), 0) + 1
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        raw = [b""] * self.size
        for token, i in ids.items():
            raw[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.added.items():
            raw[i] = token.encode()
        self.lengths = np.array([len(b) for b in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start .. start + length`` of every run, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and the number of ids of each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbols)
    if n == 0:
        return symbols, sizes
    after = np.arange(1, n + 1, dtype=np.int64)
    before = np.arange(-1, n - 1, dtype=np.int64)
    ends = np.cumsum(sizes[sizes > 0])
    after[ends - 1] = -1
    before[np.concatenate([[0], ends[:-1]])] = -1

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(places: np.ndarray, ranks: np.ndarray) -> None:
        has = ranks >= 0
        places, ranks = places[has], ranks[has]
        if len(ranks) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        first = [0, *cuts.tolist()]
        last = [*first[1:], len(ranks)]
        for rank, a, b in zip(ranks[first].tolist(), first, last, strict=True):
            if rank in index:
                index[rank].append(places[a:b])
            else:
                index[rank] = [places[a:b]]
                heapq.heappush(active, rank)

    joined = np.flatnonzero(after >= 0)
    add(joined, vocabulary.ranks(symbols[joined], symbols[joined + 1]))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        a, b, made = vocabulary.left[rank], vocabulary.right[rank], vocabulary.made[rank]
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[symbols[at] == a]
        nxt = after[at]
        keep = (nxt >= 0) & (symbols[nxt] == b)
        at = np.unique(at[keep])
        if len(at) == 0:
            continue
        if a == b and len(at) > 1:
            # In a run of equal symbols every second pair is free.
            follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
            run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        symbols[at] = made
        symbols[gone] = -1
        after[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        ahead = before[at]
        left, right = ahead[ahead >= 0], at[has]
        add(
            np.concatenate([left, right]),
            vocabulary.ranks(
                np.concatenate([symbols[left], symbols[right]]),
                np.concatenate([symbols[at[ahead >= 0]], symbols[beyond[has]]]),
            ),
        )
    alive = symbols >= 0
    totals = np.concatenate([[0], np.cumsum(alive)])
    stops = np.cumsum(sizes)
    return symbols[alive], totals[stops] - totals[stops - sizes]


class Encoder:
    """Encodes lists of texts; keeps nothing between calls."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def codes(self, text: str, book: dict[str, int]) -> np.ndarray:
        """Numbers of a text's pre-tokens in ``book``; added tokens are -1 - id."""
        find, number = self.pattern.findall, book.setdefault
        if self.added is None or not self.added.search(text):
            return np.array([number(w, len(book)) for w in find(text)], np.int32)
        out: list[int] = []
        for i, part in enumerate(self.added.split(text)):
            if i % 2:
                out.append(-1 - self.vocabulary.added[part])
            else:
                out += [number(w, len(book)) for w in find(part)]
        return np.array(out, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        book: dict[str, int] = {}
        parts = [self.codes(t, book) for t in texts]
        ids, counts = merge_words([w.encode() for w in book], self.vocabulary)
        # Added tokens follow the words as words of one id.
        extra = np.array(sorted(self.vocabulary.added.values()), np.int32)
        ids = np.concatenate([ids, extra]).astype("<u4")
        counts = np.concatenate([counts, np.ones(len(extra), np.int64)])
        starts = np.cumsum(counts) - counts
        out = []
        for codes in parts:
            if len(codes) and codes.min() < 0:
                codes = np.where(codes < 0, len(book) + np.searchsorted(extra, -1 - codes), codes)
            out.append(ids[spread(starts[codes], counts[codes])])
        return out


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    return vocabulary.bytes[spread(vocabulary.starts[ids], vocabulary.lengths[ids])].tobytes()


def _chunks(batches, column: str, limit: int):
    """Batches cut so that ``column`` has at most ``limit`` bytes, one row at least."""
    for batch in batches:
        release()
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, ends[stop - 1]


def _added_fields(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    """``df`` without columns that clash with ``fields``, and the schema with them."""
    names = {f.name.lower() for f in fields}
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    return df, T.StructType([*df.schema.fields, *fields])


def bpe_encode(
    documents: DataFrame,
    vocabulary: str = BYTE_BPE,
    text_col: str = "text",
    chunk_bytes: int = 16 << 20,
) -> DataFrame:
    """``documents`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    Columns of these names are replaced.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    df, schema = _added_fields(documents, fields)

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in _chunks(batches, text_col, chunk_bytes):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                ],
                names=schema.names,
            )

    return df.mapInArrow(run, schema)


def bpe_decode(
    encoded: DataFrame,
    vocabulary: str = BYTE_BPE,
    ids_col: str = "ids",
    out_col: str = "decoded",
    chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """``encoded`` with the text of its ids; null ids give an empty text."""
    df, schema = _added_fields(encoded, [T.StructField(out_col, T.StringType())])

    def run(batches):
        table = Vocabulary(vocabulary)
        for batch in _chunks(batches, ids_col, chunk_bytes):
            texts = [
                decode_ids(np.frombuffer(x or b"", "<u4"), table).decode("utf-8", "replace")
                for x in batch.column(ids_col).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=schema.names
            )

    return df.mapInArrow(run, schema)


def bpe_round_trip(
    documents: DataFrame,
    vocabulary: str = BYTE_BPE,
    text_col: str = "text",
    chunk_bytes: int = 6 << 20,
) -> DataFrame:
    """``documents`` without the text, with ``n_tokens``, ``ids`` and the text ``decoded``
    from them, in one pass: one worker per task instead of two."""
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()),
    ]
    df, schema = _added_fields(documents, fields)
    place = df.columns.index(text_col)
    schema = T.StructType([f for f in schema.fields if f.name != text_col])

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in _chunks(batches, text_col, chunk_bytes):
            found = encoder.encode([t or "" for t in batch.column(place).to_pylist()])
            for start in range(0, batch.num_rows, 500):
                part, ids = batch.slice(start, 500), found[start : start + 500]
                texts = [decode_ids(x, encoder.vocabulary).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c for i, c in enumerate(part.columns) if i != place),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.array(texts, pa.string()),
                    ],
                    names=schema.names,
                )

    return df.mapInArrow(run, schema)


def bpe_digests(documents: DataFrame, vocabulary: str = BYTE_BPE, id_col: str = "doc_id") -> DataFrame:
    """Encode, decode, and digest both: ids and decoded text per document."""
    return bpe_round_trip(documents.select(id_col, "text"), vocabulary).select(
        id_col,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark, folder):
    return bpe_digests(spark.read.parquet(f"{folder}/documents.parquet"))
