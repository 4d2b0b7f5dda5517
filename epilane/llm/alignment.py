"""Alignment of two tokenizers, with corpus counts of linked id pairs by external runs.

Side A is a byte-level vocabulary, read as text with one space before it; side B is a
piece model that adds this space itself. Byte offsets where tokens of both end cut a text
into groups; each A and B token of one group are linked. Links of a group are counted by
distinct ids, so a long group without common ends costs its distinct pairs.

1. A task encodes its documents and spills a run of pair-document records for every
   ``run_bytes`` of text: the run's distinct pairs sorted side-major (A, then B) with the
   number of their documents, radix-partitioned by A id, and per document the pairs it
   holds. Everything is compressed with zstd.
2. Up to ``FAN`` runs of a radix partition are merged by a heap of their blocks, level by
   level, until one run is left. All pairs of an A id stand next to each other there, so
   its highest count is at hand when the id ends.
3. The totals go back to the runs of each partition in groups of ``FAN``, as one count and
   mark per pair, and each run sums them over the records of its documents.

A frequent pair is one record a run, a frequent A id the number of its B ids. No task
holds more than ``FAN`` parts of runs and the distinct pairs of one radix partition.

Cases: null and empty texts have no tokens, nor have texts whose tokens of a side do not
join to the text again; strings of special tokens are plain text; null keys and repeated
rows are rows like others; other columns are not read; an empty table gives an empty
result. A run holds whole documents, one at least.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilane.llm.bpe import Vocabulary, spread
from epilane.llm.words import mix, release
from epilane.session import Scratch

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
A_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
RUN_BYTES = 16 << 20
FAN = 64
HEAP_BLOCK = 8192
SHIFT = 20  # of the A id in the code of a pair
WHOLE_GROUP = 256  # links of a group up to which they are listed one by one
# Characters that any version of the Unicode tables puts into the same classes.
SETTLED = regex.compile(r"[\t\n\r -~¡-¬®-ɏ‐-‧€]*")


class SideA:
    """Ids of the byte-level vocabulary, and the bytes of each.

    Texts of settled characters go through the ranks of the same vocabulary, which is
    several times faster; all others through the vocabulary's own library.
    """

    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = Vocabulary(path)
        self.lengths, self.starts, self.bytes = vocabulary.lengths, vocabulary.starts, vocabulary.bytes
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "side_a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.fast and SETTLED.fullmatch(text):
                out.append(np.array(self.fast.encode_ordinary(" " + text), np.int64))
            else:
                out.append(np.array(self.tokenizer.encode(" " + text, add_special_tokens=False).ids, np.int64))
        return out


class SideB:
    """Ids of the piece model, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            raw.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.lengths = np.array([len(b) for b in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


def _joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values one after the other, and the number of the array of each."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *arrays]), np.repeat(np.arange(len(arrays)), sizes)


def _spells(side, ids: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Which lists of ids join to their texts."""
    flat, owner = _joined(ids)
    sizes = np.array([len(t) for t in texts], np.int64)
    totals = np.zeros(len(texts), np.int64)
    np.add.at(totals, owner, side.lengths[flat])
    good = totals == sizes
    held = flat[good[owner]]
    spelt = side.bytes[spread(side.starts[held], side.lengths[held])]
    wanted = np.frombuffer(b"".join(t for t, g in zip(texts, good.tolist(), strict=True) if g), np.uint8)
    wrong = np.repeat(np.flatnonzero(good), sizes[good])[spelt != wanted]
    good[wrong] = False
    return good


def _digits(ids: np.ndarray) -> np.ndarray:
    """Decimal digits, right-aligned in rows, zero bytes before them."""
    width = len(str(int(ids.max()))) if len(ids) else 1
    powers = 10 ** np.arange(width - 1, -1, -1)
    out = (ids[:, None] // powers % 10 + 48).astype(np.uint8)
    out[(ids[:, None] < powers) & (powers > 1)] = 0
    return out


class Aligned:
    """Groups and links of some texts."""

    def __init__(self, side_a, side_b, texts: list[str | None]):
        n = len(texts)
        held = [k for k, t in enumerate(texts) if t]
        plain = [texts[k] for k in held]
        raw = [b" " + t.encode() for t in plain]
        ids_a, ids_b = side_a.encode(plain), side_b.encode(plain)
        good = _spells(side_a, ids_a, raw) & _spells(side_b, ids_b, raw) if held else np.zeros(0, bool)
        docs = np.array(held, np.int64)[good]
        self.a, own_a = _joined([x for x, g in zip(ids_a, good.tolist(), strict=True) if g])
        self.b, own_b = _joined([x for x, g in zip(ids_b, good.tolist(), strict=True) if g])
        ends_a, ends_b = np.cumsum(side_a.lengths[self.a]), np.cumsum(side_b.lengths[self.b])
        last_a = np.isin(ends_a, ends_b, assume_unique=True)
        last_b = np.isin(ends_b, ends_a, assume_unique=True)
        self.group_a, self.group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        self.size_a, self.size_b = (np.bincount(g) for g in (self.group_a, self.group_b))
        self.start_a, self.start_b = (np.cumsum(s) - s for s in (self.size_a, self.size_b))
        self.owner = docs[own_a[last_a]]  # document of each group
        self.last_a, self.last_b = last_a, last_b

        def per_document(values):
            out = np.zeros(n, np.int64)
            np.add.at(out, self.owner, values)
            return out

        self.n_a, self.n_b = per_document(self.size_a), per_document(self.size_b)
        self.n_groups = per_document(np.ones(len(self.owner), np.int64))
        self.n_links = per_document(self.size_a * self.size_b)
        self.digests = self._digests(n)

    def _digests(self, n: int) -> list[str]:
        """SHA-256 of the groups as text, '' without tokens."""
        out = [""] * n
        if not len(self.a):
            return out
        place_a = np.arange(len(self.a)) + self.start_b[self.group_a]
        place_b = np.arange(len(self.b)) + (self.start_a + self.size_a)[self.group_b]
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[place_a[self.last_a]] = ord("|")
        closing = place_b[self.last_b]
        mark[closing] = ord(";")
        final = closing[np.append(self.owner[1:] != self.owner[:-1], True)]
        mark[final] = 0  # nothing follows a document's last group
        cells = np.concatenate([_digits(ids), mark[:, None]], 1)
        used = cells != 0
        stops = np.cumsum(used.sum(1))[final]
        data = cells[used]
        starts = np.concatenate([[0], stops[:-1]])
        for doc, a, b in zip(self.owner[np.append(self.owner[1:] != self.owner[:-1], True)].tolist(), starts.tolist(), stops.tolist(), strict=True):
            out[doc] = hashlib.sha256(data[a:b].data).hexdigest()
        return out

    def records(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair code and number of links, sorted, of every linked pair."""
        links = self.size_a * self.size_b
        small = links <= WHOLE_GROUP
        mine = np.flatnonzero(small[self.group_a])
        group = self.group_a[mine]
        other = spread(self.start_b[group], self.size_b[group])
        first = np.repeat(mine, self.size_b[group])
        owner = [self.owner[self.group_a[first]]]
        code = [self.a[first] << SHIFT | self.b[other]]
        times = [np.ones(len(first), np.int64)]
        for g in np.flatnonzero(~small).tolist():
            a, count_a = np.unique(self.a[self.start_a[g] :][: self.size_a[g]], return_counts=True)
            b, count_b = np.unique(self.b[self.start_b[g] :][: self.size_b[g]], return_counts=True)
            code.append((a[:, None] << SHIFT | b[None, :]).reshape(-1))
            times.append((count_a[:, None] * count_b[None, :]).reshape(-1))
            owner.append(np.full(len(a) * len(b), self.owner[g]))
        owner, code, times = (np.concatenate(x) for x in (owner, code, times))
        order = np.lexsort((code, owner))
        owner, code, times = owner[order], code[order], times[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new)
        if len(starts):
            times = np.add.reduceat(times, starts)
        return owner[new], code[new], times


def _pack(values: np.ndarray, width: int = 8) -> bytes:
    """Integers by planes of bytes, compressed."""
    raw = values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(raw: bytes, width: int = 8) -> np.ndarray:
    data = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").reshape(-1)


def _radix(codes: np.ndarray, parts: int) -> np.ndarray:
    return (mix((codes >> SHIFT).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


RUNS = (
    "run long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>,"
    " groups_sha256 array<string>, sizes binary, places binary, times binary, pairs binary,"
    " slices array<struct<radix: long, pairs: binary, counts: binary>>"
)
SLICES = "radix long, run long, run_group long, pairs binary, counts binary"


class _Run:
    """Documents of a task until their run is spilled."""

    def __init__(self, number: int):
        self.number, self.bytes, self.keys = number, 0, []
        self.numbers = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links")}
        self.digests, self.owners, self.codes, self.times = [], [], [], []

    def add(self, keys: list, aligned: Aligned, size: int) -> None:
        owner, code, times = aligned.records()
        self.owners.append(owner + len(self.keys))
        self.codes.append(code)
        self.times.append(times)
        self.keys += keys
        self.bytes += size
        self.digests += aligned.digests
        for c, values in self.numbers.items():
            values += getattr(aligned, c).tolist()

    def row(self, parts: int) -> pa.RecordBatch:
        code = np.concatenate(self.codes)
        pairs, place, counts = np.unique(code, return_inverse=True, return_counts=True)
        sizes = np.bincount(np.concatenate(self.owners), minlength=len(self.keys))
        # Places grow within a document; the gaps need few bytes.
        gaps = np.diff(place, prepend=0)
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        gaps[firsts] = place[firsts]
        radix = _radix(pairs, parts)
        order = np.argsort(radix, kind="stable")
        cuts = np.searchsorted(radix[order], np.arange(parts + 1))
        slices = [
            {"radix": r, "pairs": _pack(np.diff(pairs[order[a:b]], prepend=0)), "counts": _pack(counts[order[a:b]])}
            for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            if a < b
        ]
        values = {
            "run": pa.array([self.number], pa.int64()),
            "doc_id": pa.array([self.keys], pa.list_(pa.int64())),
            **{c: pa.array([v], pa.list_(pa.int64())) for c, v in self.numbers.items()},
            "groups_sha256": pa.array([self.digests], pa.list_(pa.string())),
            "sizes": pa.array([_pack(sizes)], pa.binary()),
            "places": pa.array([_pack(gaps, 4)], pa.binary()),
            "times": pa.array([_pack(np.concatenate(self.times))], pa.binary()),
            "pairs": pa.array([_pack(np.diff(pairs, prepend=0))], pa.binary()),
            "slices": pa.array(
                [slices],
                pa.list_(pa.struct([("radix", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary())])),
            ),
        }
        return pa.RecordBatch.from_arrays(list(values.values()), names=list(values))


def spill_runs(documents: DataFrame, parts: int, side_a, side_b, run_bytes: int) -> DataFrame:
    """Runs of pair-document records; ``documents`` has key and text only."""

    def run(batches):
        first, second = side_a(), side_b()
        number = TaskContext.get().partitionId() << 33
        held = _Run(number)
        for batch in batches:
            keys, texts = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < 1 << 20):
                    size += len(texts[stop] or "")
                    stop += 1
                held.add(keys[at:stop], Aligned(first, second, texts[at:stop]), size)
                at = stop
                if held.bytes >= run_bytes:
                    yield held.row(parts)
                    number += 1
                    held = _Run(number)
                    release()
        if held.keys:
            yield held.row(parts)

    return documents.mapInArrow(run, RUNS)


def heap_merge(runs: list[tuple[np.ndarray, np.ndarray]]):
    """Pairs and summed counts of sorted runs, in order, a piece at a time.

    The heap holds the last pair of the current block of each run; up to the least of them
    no run can add anything from later blocks.
    """
    at, ends, heap = [0] * len(runs), [0] * len(runs), []

    def next_block(k):
        pairs = runs[k][0]
        if at[k] < len(pairs):
            ends[k] = min(at[k] + HEAP_BLOCK, len(pairs))
            heapq.heappush(heap, (int(pairs[ends[k] - 1]), k))

    for k in range(len(runs)):
        next_block(k)
    while heap:
        bound = heap[0][0]
        while heap and heap[0][0] == bound:
            heapq.heappop(heap)
        keys, counts = [], []
        for k, (pairs, times) in enumerate(runs):
            start = at[k]
            at[k] += int(np.searchsorted(pairs[start : ends[k]], bound, side="right"))
            if at[k] > start:
                keys.append(pairs[start : at[k]])
                counts.append(times[start : at[k]])
                if at[k] == ends[k]:
                    next_block(k)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield keys[starts], np.add.reduceat(counts[order], starts)


def _decoded(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [
        (np.cumsum(_unpack(p.as_py())), _unpack(c.as_py()))
        for p, c in zip(table["pairs"], table["counts"], strict=True)
    ]


def _merged(table: pa.Table) -> pa.Table:
    """One run of the runs of a radix partition and group."""
    pieces = list(heap_merge(_decoded(table)))
    pairs = np.concatenate([p for p, _ in pieces])
    counts = np.concatenate([c for _, c in pieces])
    group = table["run_group"][0].as_py()
    return pa.table(
        {
            "radix": table["radix"][:1],
            "run": pa.array([group], pa.int64()),
            "run_group": pa.array([group // FAN], pa.int64()),
            "pairs": pa.array([_pack(np.diff(pairs, prepend=0))], pa.binary()),
            "counts": pa.array([_pack(counts)], pa.binary()),
        }
    )


def highest(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their A id; ``pairs`` are sorted."""
    side = pairs >> SHIFT
    starts = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
    most = np.maximum.reduceat(counts, starts)
    return counts == np.repeat(most, np.diff(np.append(starts, len(side))))


def _answers(slices: pa.Table, totals: pa.Table) -> pa.Table:
    """Count and mark of the pairs of each run of a group, in their order."""
    (pairs, counts), *_ = _decoded(totals)
    answer = counts << 1 | highest(pairs, counts)
    out = [
        _pack(answer[np.searchsorted(pairs, np.cumsum(_unpack(p.as_py())))]) for p in slices["pairs"]
    ]
    return pa.table({"run": slices["run"], "radix": slices["radix"], "answer": pa.array(out, pa.binary())})


RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _contributions(batches, parts: int):
    """Rows per document from runs and their answers."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs = np.cumsum(_unpack(row["pairs"]))
            radix = _radix(pairs, parts)
            answer = np.zeros(len(pairs), np.int64)
            for part in row["answers"] or []:
                answer[radix == part["radix"]] = _unpack(part["answer"])
            sizes, times = _unpack(row["sizes"]), _unpack(row["times"])
            # Gaps become places again, document by document.
            steps = np.concatenate([[0], np.cumsum(_unpack(row["places"], 4), dtype=np.int64)])
            stops = np.cumsum(sizes)
            starts = stops - sizes
            places = steps[1:] - np.repeat(steps[starts], sizes)
            found = answer[places]

            def total(values, starts=starts, stops=stops):
                sums = np.concatenate([[0], np.cumsum(values)])
                return pa.array(sums[stops] - sums[starts], pa.int64())

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_id"], pa.int64()),
                    *(pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    total(times * (found & 1)),
                    total(times * (found >> 1)),
                    pa.array(row["groups_sha256"], pa.string()),
                ],
                names=[f.split()[0] for f in RESULT.split(", ")],
            )


def radix_parts(texts: DataFrame, text_col: str) -> int:
    """A radix partition for every 16 MB of text, 8 to 4,096."""
    volume = texts.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return min(max(volume >> 24, 8), 4096)


def _totals(runs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """The slices of all runs in groups, one merged run per partition, and the number of
    groups."""
    # Runs are numbered through, so that groups of FAN fill up.
    parts = runs.groupBy(F.shiftright("run", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part")
    ends, base = [], 0
    for row in parts.toLocalIterator():  # one row a task
        ends.append((row["part"], base))
        base += row["n"]
    numbers = runs.sparkSession.createDataFrame(ends, "part long, base long")
    slices = (
        runs.select("run", F.explode("slices").alias("s"))
        .withColumn("part", F.shiftright("run", 33))
        .join(numbers, "part")
        .select(
            F.col("s.radix").alias("radix"),
            "run",
            F.floor((F.col("base") + F.col("run").bitwiseAND((1 << 33) - 1)) / FAN).alias("run_group"),
            F.col("s.pairs").alias("pairs"),
            F.col("s.counts").alias("counts"),
        )
    )
    merged, level, groups = slices, 0, max(-(-base // FAN), 1)
    left = groups
    while True:
        merged = scratch.table(
            merged.groupBy("radix", "run_group").applyInArrow(_merged, SLICES), f"merged_{level}"
        )
        if left <= 1:
            return slices, merged, groups
        left, level = -(-left // FAN), level + 1


def _sides(vocabulary_a: str, ranks_a: str | None, vocabulary_b: str):
    return lambda: SideA(vocabulary_a, ranks_a), lambda: SideB(vocabulary_b)


def linked_pairs(
    documents: DataFrame,
    text_col: str = "text",
    vocabulary_a: str = A_FILE,
    ranks_a: str | None = A_RANKS,
    vocabulary_b: str = B_FILE,
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """``a_id,b_id,n_docs,is_best`` of every linked pair: in how many documents, and
    whether that is the highest count of its A id."""
    texts = documents.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for pairs, counts in _decoded(pa.Table.from_batches([batch])):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pairs >> SHIFT, pa.int64()),
                        pa.array(pairs & ((1 << SHIFT) - 1), pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(highest(pairs, counts), pa.bool_()),
                    ],
                    names=["a_id", "b_id", "n_docs", "is_best"],
                )

    with Scratch(documents.sparkSession) as scratch:
        parts = radix_parts(texts, "text")
        runs = spill_runs(texts, parts, *_sides(vocabulary_a, ranks_a, vocabulary_b), run_bytes)
        _, merged, _ = _totals(scratch.table(runs, "runs"), scratch)
        return scratch.result(
            merged.select("pairs", "counts").mapInArrow(run, "a_id long, b_id long, n_docs long, is_best boolean")
        )


def align_documents(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_a: str = A_FILE,
    ranks_a: str | None = A_RANKS,
    vocabulary_b: str = B_FILE,
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links whose pair has the highest
    count of its A id, summed counts over links, and the digest of the groups."""
    texts = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    with Scratch(documents.sparkSession) as scratch:
        parts = radix_parts(texts, "text")
        runs = scratch.table(
            spill_runs(texts, parts, *_sides(vocabulary_a, ranks_a, vocabulary_b), run_bytes), "runs"
        )
        slices, totals, groups = _totals(runs, scratch)
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
        answers = (
            slices.groupBy("radix", "run_group")
            .cogroup(totals.withColumn("run_group", each).groupBy("radix", "run_group"))
            .applyInArrow(_answers, "run long, radix long, answer binary")
            .groupBy("run")
            .agg(F.collect_list(F.struct("radix", "answer")).alias("answers"))
        )
        found = runs.drop("slices").join(answers, "run", "left").mapInArrow(
            lambda batches: _contributions(batches, parts), RESULT
        )
        return scratch.result(found.withColumnRenamed("doc_id", id_col))


def op11_token_alignment(spark, folder):
    return align_documents(spark.read.parquet(f"{folder}/documents.parquet"))
