"""Removal of long repeated byte strings by a distributed difference-cover sample.

Two equal strings of ``LENGTH`` bytes at p and q meet in the sample: for some shift below
the period, p + shift and q + shift both fall on places of the difference cover, and the
windows of ``LENGTH - PERIOD + 1`` bytes from there are equal. Three rounds follow:

1. Sampled windows get names (fingerprints). Names that occur once drop out, which leaves
   only the neighbourhood of real repeats.
2. The names recurse into longer ones that also span the bytes before and after, up to
   every string that the sample place can stand for. Equal long names prove all of these
   strings repeated at once.
3. Where a short name has several long ones (near the ends of a repeat), the remaining
   places are merged in: every string between two samples gets its own name, from one
   representative of each long name, and equal ones are adjacent.

Only equality of prefixes of ``LENGTH`` bytes is asked for, so names are ordered by
fingerprint, not by text, and the recursion ends once they span that length. Documents
are kept in blocks, in a table bucketed by block, so a round moves names and answers but
no text. Names of a block are sorted, made distinct and cut into ranges before the
shuffle, so a frequent string costs one name per block.

Cases: a null text is empty; texts shorter than ``LENGTH`` keep all bytes; null keys,
repeated rows (which repeat each other's text) and ties are rows like others; other
columns are not read; an empty table gives an empty result. A name is 48 bits in the
first round, which only narrows, and 64 bits where it decides.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilane.llm.words import PRIME, Rolling
from epilane.session import Scratch

LENGTH = 400
# A perfect difference set: every residue is the difference of two members.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SEED = 20
ROLLING = Rolling(SEED)
TABLES = np.random.default_rng(SEED).integers(1, int(PRIME), (2, 256), dtype=np.uint64)

BLOCKS = "block long, keys array<long>, sizes array<long>, data binary"
NAMES = "bucket long, block long, names binary, more binary"
ANSWERS = "block long, bucket long, answer binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Text:
    """The bytes of a block with the borders of its documents and rolling names."""

    def __init__(self, sizes, data: bytes):
        self.sizes = np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.bytes = np.frombuffer(
            pa.decompress(data, int(self.sizes.sum()), "zstd", asbytes=True), np.uint8
        )
        self.sums = ROLLING.sums([t[self.bytes] for t in TABLES])

    def name(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Fingerprints of the strings from ``start`` to ``stop``."""
        return ROLLING.name(self.sums, start, stop)

    def borders(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the document of each place."""
        doc = np.searchsorted(self.ends, places, side="right")
        return self.ends[doc] - self.sizes[doc], self.ends[doc]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places whose window ends in their document, and their names (48 bits)."""
        window = LENGTH - PERIOD + 1
        n = max(len(self.bytes) - window + 1, 0)
        rounds = np.arange(0, n, PERIOD)[:, None] + np.array(COVER)[None, :]
        places = rounds.reshape(-1)
        places = places[places < n]
        places = places[places + window <= self.borders(places)[1]]
        return places, self.name(places, places + window) >> np.uint64(16)


def _six(names: np.ndarray) -> bytes:
    """48-bit names as six bytes each."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _cuts(names: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket, a range of values, starts in sorted names."""
    width = (1 << bits) // buckets + 1
    return np.searchsorted(names, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width))


def _names_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["bucket", "block", "names", "more"],
    )


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``values``, and the number of the group of each sorted value."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    return order, np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))


def _answers(table: pa.Table, counts: list[int], answer: np.ndarray) -> pa.Table:
    ends = np.cumsum([0, *counts])
    parts = [answer[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table(
        {"block": table["block"], "bucket": table["bucket"], "answer": pa.array(parts, pa.binary())}
    )


def _eight(names: np.ndarray) -> bytes:
    return names.astype("<u8").tobytes()


def _from_eight(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def repeated_names(table: pa.Table, unpack) -> pa.Table:
    """One byte per name of a bucket: does it occur twice or more?

    ``more`` has a byte per name that tells whether its block holds it more than once.
    """
    names = [unpack(x.as_py()) for x in table["names"]]
    more = np.frombuffer(b"".join(x.as_py() for x in table["more"]), np.uint8)
    order, group = _groups(np.concatenate(names))
    twice = np.bincount(group, weights=1 + more[order]) >= 2
    answer = np.zeros(len(order), np.uint8)
    answer[order] = twice[group]
    return _answers(table, [len(x) for x in names], answer)


def proven_names(table: pa.Table) -> pa.Table:
    """One byte per pair of short and long name: 1 if the pair occurs twice or more, plus 2
    if the short name has other long ones and this block's strings stand for the pair."""
    pairs = [np.frombuffer(x.as_py(), "<u8").reshape(2, -1) for x in table["names"]]
    short = np.concatenate([x[0] for x in pairs])
    long = np.concatenate([x[1] for x in pairs])
    more = np.frombuffer(b"".join(x.as_py() for x in table["more"]), np.uint8)
    order = np.lexsort((long, short))
    short, long = short[order], long[order]
    new_short = np.concatenate([[True], short[1:] != short[:-1]])
    new_pair = new_short | np.concatenate([[True], long[1:] != long[:-1]])
    pair = np.cumsum(new_pair) - 1
    proven = np.bincount(pair, weights=1 + more[order]) >= 2
    group = np.cumsum(new_short) - 1
    mixed = np.bincount(group, weights=new_pair) >= 2
    answer = np.zeros(len(order), np.uint8)
    answer[order] = proven[pair] + 2 * (mixed[group] & new_pair)
    return _answers(table, [x.shape[1] for x in pairs], answer)


def _first_round(text: Text):
    """Distinct sampled names, how to get back to the places, and which occur twice."""
    places, names = text.samples()
    distinct, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    return places, distinct, inverse, counts > 1


def _second_round(text: Text, answer: np.ndarray):
    """Distinct (short, long) pairs of the repeated samples, with their strings.

    The strings that a sample stands for start between ``low`` and ``high``.
    """
    places, distinct, inverse, _ = _first_round(text)
    held = answer[inverse].astype(bool)
    places, short = places[held], distinct[inverse[held]]
    start, end = text.borders(places)
    low = np.maximum(places - PERIOD + 1, start)
    stop = np.minimum(places + LENGTH, end)
    reach = ((places - low) << 10 | (stop - places)).astype(np.uint64)
    long = text.name(low, stop) ^ (reach * np.uint64(0xD6E8FEB86659FD93))
    order = np.lexsort((long, short))
    places, short, long = places[order], short[order], long[order]
    low, high = low[order], np.minimum(places, end[order] - LENGTH)
    new = np.ones(len(order), bool)
    new[1:] = (short[1:] != short[:-1]) | (long[1:] != long[:-1])
    return short, long, low, high, new


def _runs(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Flags of the places in any of the ranges ``low`` to ``high``, both included."""
    fits = low <= high
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, low[fits], 1)
    np.add.at(steps, high[fits] + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _third_round(text: Text, answer: np.ndarray, proof: np.ndarray):
    """Proven places, and distinct names of the strings still to be judged."""
    _, _, low, high, new = _second_round(text, answer)
    pair = np.cumsum(new) - 1
    n = len(text.bytes)
    is_proven = (proof & 1).astype(bool)[pair] if len(pair) else np.zeros(0, bool)
    proven = _runs(low[is_proven], high[is_proven], n)
    stands = new & ((proof & 2).astype(bool)[pair] if len(pair) else np.zeros(0, bool))
    places = np.flatnonzero(_runs(low[stands], high[stands], n))
    names = text.name(places, places + LENGTH)
    distinct, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    return proven, places, distinct, inverse, counts > 1


def _joined(row_answers) -> np.ndarray:
    """The answers of a block's buckets one after the other."""
    parts = sorted(((x["bucket"], x["answer"]) for x in row_answers or []), key=lambda x: x[0])
    return np.frombuffer(b"".join(x[1] for x in parts), np.uint8)


def to_blocks(documents: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Whole documents in blocks of about ``block_bytes``, compressed."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        keys, texts, held = [], [], 0

        def flush():
            nonlocal number, keys, texts, held
            row = {
                "block": [(part << 33) + number],
                "keys": [keys],
                "sizes": [[len(t) for t in texts]],
                "data": [pa.compress(b"".join(texts), "zstd", asbytes=True)],
            }
            number, keys, texts, held = number + 1, [], [], 0
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row)
            )

        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(key)
                texts.append((text or "").encode())
                held += len(texts[-1])
                if held >= block_bytes:
                    yield flush()
        if keys:
            yield flush()

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, BLOCKS)


class _Rounds:
    """The bucketed table of blocks and the exchange of names for answers."""

    def __init__(self, spark: SparkSession, scratch: Scratch, blocks: DataFrame, volume: int):
        self.spark, self.scratch = spark, scratch
        parts = min(max(volume >> 25, 8), 20_000)
        self.buckets = min(max(volume >> 24, 8), 100_000)
        self.name = f"epilane_blocks_{uuid.uuid4().hex}"
        (
            blocks.repartition(parts, "block")
            .write.bucketBy(parts, "block")
            .option("path", f"{scratch.path}/blocks")
            .option("compression", "uncompressed")
            .saveAsTable(self.name)
        )
        self.blocks = spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")

    def ask(self, frame: DataFrame, emit, reduce, name: str) -> DataFrame:
        """Send the names that ``emit`` gives per block row, reduce each bucket, and
        gather a block's answers in one row."""
        sent = frame.mapInArrow(emit, NAMES)
        answers = sent.groupBy("bucket").applyInArrow(reduce, ANSWERS)
        gathered = answers.groupBy("block").agg(
            F.collect_list(F.struct("bucket", "answer")).alias(name)
        )
        return self.scratch.table(gathered, name)

    def join(self, frame: DataFrame, answers: DataFrame) -> DataFrame:
        return frame.join(answers, "block", "left")


def _each_block(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 20
) -> DataFrame:
    """Per document: bytes, removed bytes and runs, SHA-256 of the bytes kept."""
    spark = documents.sparkSession
    with Scratch(spark) as scratch:
        volume = documents.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        rounds = _Rounds(
            spark, scratch, to_blocks(documents, id_col, text_col, block_bytes), volume
        )
        buckets = rounds.buckets

        def first(batches):
            for row in _each_block(batches):
                _, distinct, _, more = _first_round(Text(row["sizes"], row["data"]))
                cuts = _cuts(distinct, 48, buckets).tolist()
                yield _names_batch(
                    [
                        (k, row["block"], _six(distinct[a:b]), more[a:b].astype(np.uint8).tobytes())
                        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                        if a < b
                    ]
                )

        def second(batches):
            for row in _each_block(batches):
                text = Text(row["sizes"], row["data"])
                short, long, _, _, new = _second_round(text, _joined(row["first"]))
                at = np.flatnonzero(new)
                more = (np.diff(np.concatenate([at, [len(new)]])) > 1).astype(np.uint8)
                cuts = _cuts(short[at], 48, buckets).tolist()
                yield _names_batch(
                    [
                        (
                            k,
                            row["block"],
                            _eight(np.stack([short[at[a:b]], long[at[a:b]]])),
                            more[a:b].tobytes(),
                        )
                        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                        if a < b
                    ]
                )

        def third(batches):
            for row in _each_block(batches):
                text = Text(row["sizes"], row["data"])
                answers = _joined(row["first"]), _joined(row["second"])
                _, _, distinct, _, more = _third_round(text, *answers)
                cuts = _cuts(distinct >> np.uint64(16), 48, buckets).tolist()
                yield _names_batch(
                    [
                        (
                            k,
                            row["block"],
                            _eight(distinct[a:b]),
                            more[a:b].astype(np.uint8).tobytes(),
                        )
                        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                        if a < b
                    ]
                )

        def finish(batches):
            for row in _each_block(batches):
                text = Text(row["sizes"], row["data"])
                answers = _joined(row["first"]), _joined(row["second"])
                proven, places, _, inverse, _ = _third_round(text, *answers)
                judged = _joined(row["third"])
                if len(places):
                    proven[places[judged[inverse].astype(bool)]] = True
                at = np.flatnonzero(proven)
                gone = _runs(at, at + LENGTH - 1, len(text.bytes))
                rows = []
                for key, size, end in zip(row["keys"], row["sizes"], text.ends, strict=True):
                    cut = gone[end - size : end]
                    kept = text.bytes[end - size : end][~cut]
                    spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if size else 0
                    digest = hashlib.sha256(kept.tobytes()).hexdigest()
                    rows.append((key, size, int(cut.sum()), spans, digest))
                columns = list(zip(*rows, strict=True))
                kinds = [*[pa.int64()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

        try:
            state = rounds.blocks
            for name, emit, reduce in (
                ("first", first, lambda t: repeated_names(t, _from_six)),
                ("second", second, proven_names),
                ("third", third, lambda t: repeated_names(t, _from_eight)),
            ):
                answers = rounds.ask(state, emit, reduce, name)
                state = rounds.join(state, answers)
            return scratch.result(state.mapInArrow(finish, RESULT))
        finally:
            rounds.drop()


def op2_suffix_dedup(spark, folder):
    return remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
