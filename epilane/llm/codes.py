"""Vector codes by ball k-means: a codebook for each part of the vectors, all in integers.

Components become ``floor(256 * x)``; vectors are cut into equal consecutive parts, and
each part position has a codebook of up to 64 entries, started from the vectors with the
smallest keys. A round assigns every part to the nearest entry (ties to the lower index)
and replaces each entry by the floor of its parts' mean.

The first round compares with every entry. Later ones start from the entry that a part
had: an entry's ball reaches to its farthest part (one grouped maximum), another entry is
its neighbour only if half their distance lies within the ball. A part nearer to its
entry than half the way to the nearest neighbour lies in the stable core and is done;
others are compared with the neighbours of their ring, those no farther than twice their
own distance. All bounds are integers and let ties through, so the result is that of
comparing with every entry.

What leaves the tasks are sums, counts and radii per entry, a few thousand numbers.

Cases: rows whose vector is null or holds a null or non-finite component are left out;
vectors shorter than the longest, rounded up to whole parts, count as filled up with
zeros; null keys are never among the smallest unless others run out; repeated keys and
rows are rows like others, taken as seeds in order of their vectors; other columns are
not read; an empty table gives an empty result. Components whose integer exceeds 2^26 in
size do not fit sums of 64 bits and fail.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.llm.bpe import spread
from epilane.session import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 26
BATCH = 4096  # vectors at once
STATE = "vec_id long, label string, whole binary, code binary, error long"


def whole_vectors(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` without unusable ones, with ``whole``: the integers of their components."""

    def integer(x: Column) -> Column:
        value = F.floor(x.cast("double") * SCALE)
        big = F.raise_error(F.lit("a component is too large for sums of 64 bits")).cast("int")
        return F.when(F.abs(value) <= LARGEST, value.cast("int")).otherwise(big)

    def finite(x: Column) -> Column:
        value = x.cast("double")
        return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))

    usable = F.col(vec_col).isNotNull() & F.forall(vec_col, finite)
    return vectors.filter(usable).withColumn("whole", F.transform(vec_col, integer))


class Neighbours(NamedTuple):
    """Per part and entry: other entries whose half distance lies in its ball, nearest first."""

    squared: np.ndarray  # (part, entry, rank), beyond the last neighbour the largest integer
    index: np.ndarray


def neighbours(books: np.ndarray, radii: np.ndarray) -> Neighbours:
    """``radii`` are the squared distances of each entry's farthest part, -1 for none."""
    gaps = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(3)
    far = gaps > 4 * radii[:, :, None]
    far |= np.eye(books.shape[1], dtype=bool)[None]
    gaps[far] = np.iinfo(np.int64).max
    index = np.argsort(gaps, axis=2, kind="stable")
    return Neighbours(np.take_along_axis(gaps, index, 2), index)


def nearest_of_all(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance; ``x`` has one part of many vectors."""
    far = np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best]


def nearest_in_rings(x: np.ndarray, had: np.ndarray, book: np.ndarray, squared: np.ndarray, index: np.ndarray):
    """The same, from the entry that each part had and its sorted neighbours."""
    own = ((x - book[had]) ** 2).sum(1)
    best = had.copy()
    distance = own.copy()
    # Ring: how many neighbours lie within twice the distance; none in the stable core.
    ring = np.zeros(len(x), np.int64)
    for entry in np.unique(had):
        mine = had == entry
        ring[mine] = np.searchsorted(squared[entry], 4 * own[mine], side="right")
    open_ = np.flatnonzero(ring)
    if len(open_):
        sizes = ring[open_]
        rank = spread(np.zeros(len(open_), np.int64), sizes)
        row = np.repeat(open_, sizes)
        other = index[had[row], rank]
        far = ((x[row] - book[other]) ** 2).sum(1)
        starts = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(far, starts)
        lowest = np.minimum.reduceat(
            np.where(far == np.repeat(least, sizes), other, len(book)), starts
        )
        better = (least < own[open_]) | ((least == own[open_]) & (lowest < had[open_]))
        best[open_[better]] = lowest[better]
        distance[open_[better]] = least[better]
    return best, distance


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _matrix(part: pa.RecordBatch, parts: int) -> np.ndarray:
    """(vector, part, component) of a batch."""
    raw = b"".join(part.column("whole").to_pylist())
    return np.frombuffer(raw, "<i4").reshape(part.num_rows, parts, -1).astype(np.int64)


def _codes(part: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)


def _assign(state: DataFrame, books: np.ndarray, near: Neighbours | None) -> DataFrame:
    """``state`` with the codes and errors under ``books``."""
    parts = len(books)

    def run(batches):
        for part in _slices(batches):
            x = _matrix(part, parts)
            had = _codes(part, parts) if near else None
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                if near:
                    best, distance = nearest_in_rings(
                        x[:, p], had[:, p], books[p], near.squared[p], near.index[p]
                    )
                else:
                    best, distance = nearest_of_all(x[:, p], books[p])
                codes[:, p] = best
                error += distance
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("vec_id", "label", "whole")),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error, pa.int64()),
                ],
                names=["vec_id", "label", "whole", "code", "error"],
            )

    return state.mapInArrow(run, STATE)


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books of the next round: floors of the means of each entry's parts."""
    parts, entries, width = books.shape

    def run(batches):
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for part in _slices(batches):
            x, codes = _matrix(part, parts), _codes(part, parts)
            x = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], 2)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
        flat = sums.reshape(-1)
        held = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array(flat[held], pa.int64())], names=["cell", "total"]
        )

    totals = state.mapInArrow(run, "cell long, total long").groupBy("cell").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    flat = [0] * (parts * entries * (width + 1))
    for row in totals.collect():  # at most parts * entries * (width + 1) rows
        flat[row["cell"]] = int(row["total"])
    out = books.copy()
    for p in range(parts):
        for e in range(entries):
            at = (p * entries + e) * (width + 1)
            if count := flat[at + width]:
                out[p, e] = [total // count for total in flat[at : at + width]]
    return out


def _radii(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Squared distance of each entry's farthest part; -1 for entries without parts."""
    parts, entries, _ = books.shape

    def run(batches):
        most = np.full((parts, entries), -1, np.int64)
        for part in _slices(batches):
            x, codes = _matrix(part, parts), _codes(part, parts)
            for p in range(parts):
                np.maximum.at(most[p], codes[:, p], ((x[:, p] - books[p, codes[:, p]]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(parts * entries), pa.int64()), pa.array(most.reshape(-1), pa.int64())],
            names=["cell", "most"],
        )

    out = np.full(parts * entries, -1, np.int64)
    found = state.mapInArrow(run, "cell long, most long").groupBy("cell").agg(F.max("most").alias("most"))
    for row in found.collect():  # parts * entries rows
        out[row["cell"]] = row["most"]
    return out.reshape(parts, entries)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Per kept vector: code (two hex digits a part), squared error, the summed error of
    its label, and the digest of all codebooks. At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    spark = vectors.sparkSession
    kept = whole_vectors(
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(label_col).cast("string").alias("label"),
            F.col(vec_col).alias("vector"),
        ),
        "vector",
    )
    longest = kept.agg(F.max(F.size("whole"))).first()[0] or 0
    size = max(-(-longest // parts), 1) * parts
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()
    if not seeds:
        return spark.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        )
    books = np.array([s["whole"] + [0] * (size - len(s["whole"])) for s in seeds], np.int64)
    books = books.reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()

    def pack(batches):
        for part in _slices(batches):
            raw = [np.array(v, "<i4") for v in part.column("whole").to_pylist()]
            packed = [np.pad(v, (0, size - len(v))).tobytes() for v in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id"),
                    part.column("label"),
                    pa.array(packed, pa.binary()),
                    pa.nulls(part.num_rows, pa.binary()),
                    pa.nulls(part.num_rows, pa.int64()),
                ],
                names=["vec_id", "label", "whole", "code", "error"],
            )

    with Scratch(spark) as scratch:
        state, near = kept.select("vec_id", "label", "whole").mapInArrow(pack, STATE), None
        for k in range(rounds):
            state = scratch.table(_assign(state, books, near), f"round_{k}")
            books = _means(state, books)
            near = neighbours(books, _radii(state, books))
        done = scratch.table(_assign(state, books, near).drop("whole"), "codes")
        # Labels may be many; the summed side is small or split with a hot label.
        sums = done.groupBy("label").agg(F.sum("error").alias("label_error"))
        key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label"))
        joined = done.withColumn("key", key).join(
            sums.select(key.alias("key"), "label_error"), "key"
        )
        return scratch.result(
            joined.select(
                F.col("vec_id").alias(id_col),
                F.lower(F.hex("code")).alias("code"),
                "error",
                "label_error",
                F.lit(books_digest(books)).alias("codebooks_sha256"),
            )
        )


def op13_vector_codes(spark, folder):
    return compress_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
