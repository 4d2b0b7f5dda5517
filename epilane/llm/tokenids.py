"""Token ids in Huffman-coded files: canonical, length-limited, read block by block.

Documents are ordered by key over range partitions, encoded with a public tokenizer and
given an end id. One code, built from the counts of all ids, serves all files. A file is a
row of independent blocks; a block holds whole documents, the bit offset of every
``STEP``-th id, and the bits. All stretches between these offsets are decoded side by
side with one table.

Cases: a null text is an empty one, so only its end id is written; a null key comes
first; repeated rows are written as often as they occur; other columns are not read; an
empty table gives no file and an empty result. A task that is run again writes new
files, and the list of blocks names only those of the attempt that counted.
"""

from __future__ import annotations

import os
import struct
import uuid
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilane.llm.bpe import spread
from epilane.llm.words import WordHasher, release
from epilane.session import Scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
STEP = 64
HEAD = 64  # characters of a text that order the rows of one key
ORDER = ("doc_id", "head", "row")
MAGIC = b"EPHB"
HEADER = "<4sBqqIIQ"  # magic, longest code, part, first id, documents, ids, bits
# The pieces of the vocabulary's splitter; letters that need no normalizing.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LATIN = regex.compile(f"[!-~{chr(0xA1)}-{chr(0x12F)}{chr(0x131)}-{chr(0x24F)}]+")


class WordCache:
    """Encodes texts with the library, each distinct word of a task once.

    The normalizer and the splitter of the vocabulary never join what ASCII white space
    parts, so a text's ids are those of its words in order. Plain Latin words are cut
    into the splitter's pieces first, and distinct pieces are encoded many to a call; the
    ids that end a piece show where each stops. Other words are encoded one by one.
    Holds about ``limit`` words, by 64-bit fingerprint, and ``most_pieces`` pieces.
    """

    def __init__(self, path: str, limit: int = 1_000_000, most_pieces: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
        self.hasher = WordHasher(fold=False)
        self.limit, self.most_pieces = limit, most_pieces
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted fingerprints
        self.starts = np.zeros(0, np.int64)  # of the ids of each
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")
        self.clear_pieces()

    def clear_pieces(self) -> None:
        self.book: dict[str, int] = {}  # numbers of the pieces
        self.piece_ids = np.zeros(0, "<u4")
        self.piece_counts = np.zeros(0, np.int64)

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces one after the other, and how many each has."""
        joined = [" ".join(texts[i : i + 500]) for i in range(0, len(texts), 500)]
        ids = self._ids(joined)[0]
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(texts):
            return self.singly(texts)
        return ids, np.diff(stops, prepend=0)

    def singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._ids(texts)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and their numbers; the library's objects live for 20 texts."""
        parts, counts = [np.zeros(0, "<u4")], []
        for at in range(0, len(texts), 20):
            for x in self.tokenizer.encode_batch_fast(texts[at : at + 20], add_special_tokens=False):
                parts.append(np.array(x.ids, "<u4"))
                counts.append(len(parts[-1]))
        return np.concatenate(parts), np.array(counts, np.int64)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.book) > self.most_pieces:
            self.clear_pieces()
        book, known = self.book, len(self.book)
        number = book.setdefault
        plain, rare, codes, sizes = [], [], [], []
        for k, word in enumerate(words):
            if not LATIN.fullmatch(word) or "<|" in word:
                rare.append(k)
                continue
            plain.append(k)
            word = word.lower()
            if word.isalpha():
                codes.append(number(word, len(book)))
                sizes.append(1)
            else:
                parts = PIECES.findall(word)
                codes += [number(p, len(book)) for p in parts]
                sizes.append(len(parts))
        if len(book) > known:
            ids, counts = self.pieces(list(islice(book, known, None)))
            self.piece_ids = np.concatenate([self.piece_ids, ids])
            self.piece_counts = np.concatenate([self.piece_counts, counts])
        ids, counts = self.piece_ids, self.piece_counts
        starts = np.cumsum(counts) - counts
        codes = np.array(codes, np.int64)
        plain_ids = ids[spread(starts[codes], counts[codes])]
        ends = np.concatenate([[0], np.cumsum(counts[codes])])
        stops = np.cumsum(np.array(sizes, np.int64))
        plain_counts = np.diff(ends[stops], prepend=0)
        rare_ids, rare_counts = (
            self.singly([words[k] for k in rare]) if rare else (self.ids[:0], self.counts[:0])
        )
        order = np.array(plain + rare, np.int64)
        counts, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        counts[order] = np.concatenate([plain_counts, rare_counts])
        starts[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, plain_ids, rare_ids])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.starts = np.insert(self.starts, place, starts)
        self.counts = np.insert(self.counts, place, counts)

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        if len(self.keys) > self.limit:
            self.clear()
        raw = [t.encode() for t in texts]
        data, first, stop, hashes, owner = self.hasher.words(raw)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        inside = np.minimum(place, max(len(self.keys) - 1, 0))
        new = self.keys[inside] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            joined, spots = data.tobytes(), at[new]
            words = [
                joined[a:b].decode()
                for a, b in zip(first[spots].tolist(), stop[spots].tolist(), strict=True)
            ]
            self.learn(distinct[new], words)
        place = np.searchsorted(self.keys, distinct)
        starts, counts = self.starts[place], self.counts[place]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        end = np.array([end_id], "<u4")
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            codes = inverse[a:b]
            out.append(np.concatenate([self.ids[spread(starts[codes], counts[codes])], end]))
        return out


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code length per id by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # Per level: which items of the sorted list are leaves. Packages pair neighbours.
    levels, merged = [], np.zeros(0)
    for _ in range(limit):
        items = np.concatenate([weights, merged])
        place = np.argsort(items, kind="stable")
        levels.append(place < n)
        items = items[place]
        even = len(items) // 2 * 2
        merged = items[0:even:2] + items[1:even:2]
    # From the top level take 2n - 2 items; each package taken stands for two below.
    depth = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(levels):
        taken = int(leaf[:take].sum())
        depth[:taken] += 1
        take = 2 * (take - taken)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order) == 0:
        return codes
    size = lengths[order].astype(np.int64)
    top = int(size[-1])
    step = np.left_shift(np.uint64(1), (top - size).astype(np.uint64))
    first = np.cumsum(step, dtype=np.uint64) - step
    codes[order] = first >> (top - size).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Longest code; id and length for every value of that many bits."""
    top = max(int(lengths.max(initial=0)), 1)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = np.left_shift(1, top - lengths[order].astype(np.int64))
    ids = np.zeros(1 << top, "<u4")
    sizes = np.ones(1 << top, np.int64)
    filled = np.repeat(order, width)
    ids[: len(filled)] = filled
    sizes[: len(filled)] = lengths[filled]
    return top, ids, sizes


def pack_block(part, first, keys, docs: list[np.ndarray], lengths, codes) -> bytes:
    """One block: header, keys, sizes, bit offsets of every ``STEP``-th id, bits."""
    ids = np.concatenate(docs)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    bits = int(end[-1])
    words = np.zeros(bits // 64 + 2, np.uint64)
    code = codes[ids]
    word, room = start >> 6, 64 - (start & 63) - size
    high = np.where(
        room >= 0,
        code << np.maximum(room, 0).astype(np.uint64),
        code >> np.maximum(-room, 0).astype(np.uint64),
    )
    firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[firsts]] = np.bitwise_or.reduceat(high, firsts)
    over = np.flatnonzero(room < 0)  # one code at most crosses into a word
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    has = np.array([k is not None for k in keys], np.uint8)
    return b"".join(
        [
            struct.pack(HEADER, MAGIC, int(lengths.max()), part, first, len(docs), len(ids), bits),
            has.tobytes(),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([len(d) for d in docs], "<u4").tobytes(),
            start[::STEP].astype("<u8").tobytes(),
            words.astype(">u8").tobytes(),
        ]
    )


def unpack_block(raw: bytes, table) -> tuple[int, int, list, list[np.ndarray]]:
    """Part, place of the first id, keys and ids of the documents of a block."""
    magic, top, part, first, n_docs, n_ids, _ = struct.unpack_from(HEADER, raw)
    bits, ids, sizes = table
    if magic != MAGIC or top != bits:
        raise ValueError("not a block of this code")
    at = struct.calcsize(HEADER)
    has = np.frombuffer(raw, np.uint8, n_docs, at)
    at += n_docs
    keys = np.frombuffer(raw, "<i8", n_docs, at)
    at += 8 * n_docs
    counts = np.frombuffer(raw, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    lanes = -(-n_ids // STEP)
    place = np.frombuffer(raw, "<u8", lanes, at).astype(np.int64)
    at += 8 * lanes
    data = np.frombuffer(raw, np.uint8, len(raw) - at, at)
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    out = np.zeros((STEP, lanes), "<u4")
    last = len(window) - 1
    for k in range(STEP):
        value = (window[np.minimum(place >> 3, last)] >> (32 - bits - (place & 7))) & ((1 << bits) - 1)
        out[k] = ids[value]
        place += sizes[value]
    flat = out.T.reshape(-1)[:n_ids]
    cuts = np.concatenate([[0], np.cumsum(counts)])
    docs = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return part, first, [int(k) if h else None for k, h in zip(keys, has, strict=True)], docs


TOKENS = "part long, doc_id long, start long, n_tokens long, ids binary"
BLOCKS = "file string, offset long, length long, part long, n_tokens long"
DECODED = "doc_id long, part long, start long, n_tokens long, ids binary"


def tokenize(
    documents: DataFrame,
    vocabulary: str = WORD_BPE,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 1 << 20,
) -> DataFrame:
    """Ids of each document in ascending order of keys; ``start`` counts within the part.

    Ids are little-endian unsigned 32-bit integers. Part numbers ascend with the keys; rows
    of one key go by the start of their texts and their place in the table, so that a key
    with very many rows may span several parts.
    A part has about 128 MB of text, so that words recur within it.
    """
    volume = documents.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    parts = max(volume >> 27, min(cores, volume >> 22), 1)
    ordered = (
        documents.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        )
        .withColumns({"head": F.substring("text", 1, HEAD), "row": F.monotonically_increasing_id()})
        .repartitionByRange(parts, *ORDER)
        .sortWithinPartitions(*ORDER)
        .select("doc_id", "text")
    )

    def run(batches):
        cache, part, at = WordCache(vocabulary), TaskContext.get().partitionId(), 0
        for number, (keys, texts) in enumerate(_text_chunks(batches, chunk_bytes)):
            if number % 8 == 0:
                release()
            found = cache.encode(texts, end_id)
            sizes = np.array([len(x) for x in found], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), part, np.int64)),
                    pa.array(keys, pa.int64()),
                    pa.array(starts),
                    pa.array(sizes),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                ],
                names=["part", "doc_id", "start", "n_tokens", "ids"],
            )

    return ordered.mapInArrow(run, TOKENS)


def _text_chunks(batches, limit: int):
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            held, stop = 0, start
            while stop < batch.num_rows and held < limit:
                held += len(batch.column(1)[stop].as_buffer())
                stop += 1
            part = batch.slice(start, stop - start)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
            start = stop


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; one number per id of the vocabulary comes to the driver."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            found = np.bincount(np.frombuffer(raw, "<u4"), minlength=len(total))
            found[: len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"]
        )

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").sum("n").collect()
    counts = np.zeros(max((r[0] for r in rows), default=-1) + 1, np.int64)
    for i, n in rows:
        counts[i] = n
    return counts


def write_ids(
    tokens: DataFrame, folder: str, lengths: np.ndarray, block_ids: int = 1 << 18
) -> DataFrame:
    """Write the documents of ``tokens`` as blocks of whole documents; list the blocks.

    A block ends at the first document that takes it to ``block_ids`` ids.
    """
    codes = canonical_codes(lengths)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, f"{uuid.uuid4().hex}.ids", 0
        part, first, keys, docs, held, done = None, 0, [], [], 0, []

        def flush():
            nonlocal out, at, keys, docs, held
            if not keys:
                return
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            raw = pack_block(part, first, keys, docs, lengths, codes)
            out.write(raw)
            done.append((name, at, len(raw), part, held))
            at += len(raw)
            keys, docs, held = [], [], 0

        try:
            for batch in batches:
                for p, key, start, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if p != part or held >= block_ids or start != first + held:
                        flush()
                        part, first = p, start
                    keys.append(key)
                    docs.append(np.frombuffer(raw, "<u4"))
                    held += n
            flush()
        finally:
            if out is not None:
                out.close()
        columns = list(zip(*done, strict=True)) if done else [()] * 5
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["file", "offset", "length", "part", "n_tokens"],
        )

    return tokens.select("part", "doc_id", "start", "n_tokens", "ids").mapInArrow(run, BLOCKS)


def read_ids(blocks: DataFrame, folder: str, lengths: np.ndarray) -> DataFrame:
    """The documents of the blocks; ``start`` counts within the part."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        table = decode_table(lengths)
        for batch in batches:
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    source.seek(at)
                    part, first, keys, docs = unpack_block(source.read(size), table)
                sizes = np.array([len(d) for d in docs], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(np.full(len(keys), part, np.int64)),
                        pa.array(first + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array([d.tobytes() for d in docs], pa.binary()),
                    ],
                    names=["doc_id", "part", "start", "n_tokens", "ids"],
                )

    # By bytes of the files, which the few bytes of a row of this list do not show.
    volume = blocks.agg(F.sum("length")).first()[0] or 0
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    places = blocks.select("file", "offset", "length").repartition(
        max(volume >> 25, min(cores, volume >> 20), 1), "file", "offset"
    )
    return places.mapInArrow(run, DECODED)


def part_starts(blocks: DataFrame) -> DataFrame:
    """Ids of all parts before each part; one row per part of 128 MB comes to the driver."""
    rows = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([0, *(r["n"] for r in rows)])
    found = [(r["part"], int(at)) for r, at in zip(rows, ends, strict=False)]
    return blocks.sparkSession.createDataFrame(found, "part long, base long")


def id_digests(decoded: DataFrame, starts: DataFrame) -> DataFrame:
    """Place, size and checksum of the ids of each document."""
    return decoded.join(F.broadcast(starts), "part").select(
        "doc_id",
        (F.col("base") + F.col("start")).alias("start"),
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
    )


def op8_token_ids(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    with Scratch(spark) as scratch:
        files = f"{scratch.path}/files"
        tokens = scratch.table(tokenize(documents), "tokens")
        counts = id_counts(tokens)
        lengths = code_lengths(counts, max(16, int(np.count_nonzero(counts)).bit_length()))
        blocks = scratch.table(write_ids(tokens, files, lengths), "blocks")
        return scratch.result(id_digests(read_ids(blocks, files, lengths), part_starts(blocks)))
