"""Jaccard join of word shingles by prefix filtering, rarest shingles first.

Every set lists its shingles in one global order, rarest first. Two sets of similarity t
share one of their first ``n - ceil(t * n) + 1`` shingles, so only these prefixes are
joined. The order is (class of the shingle's count, hash); counts come from a sketch of
fixed size over all documents, and any order gives the same links: a coarse count only
costs candidates.

A pair that meets at places i and j of a shared shingle must pass

* length: the smaller set is large enough for the larger one,
* position: ``min(n_a - i, n_b - j)`` shingles from there on suffice (at the first shared
  shingle of a true link they do),
* suffix: per class of hashes, the smaller count of both sets bounds what they share.

The pairs that are left are made distinct and each is confirmed once on the whole sets.

No bucket emits all its pairs. Equal sets are one node. First each member meets only the
best-scored member of its bucket (for copies, the original); confirmed links join nodes to
components. Then buckets that hold several components list the pairs of different
components that pass length and position, large buckets in tiles. Copies are not
expanded: the result is a class per document.

Cases: a null or wordless text has an empty set and is linked with nothing; under five
words the whole sequence is the one shingle; a null key takes no part and has no
component; several texts under one key are nodes of their own; repeated rows and ties are
equal sets; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.llm.neardup import Shingler, components, confirm, keyed_texts, text_slices
from epilane.llm.words import mix
from epilane.session import Scratch

SIMILARITY = 0.8
CELLS = 1 << 22  # of the sketch: 4 MB of classes in every task
BLOCK = 1 << 16  # cells a row
FAN = 64  # rows summed at once
CLASSES = 64  # of hashes, for the suffix filter
BUCKET = 32  # members up to which a bucket's pairs are listed in SQL
TILE = 512
U = np.uint64


def distinct_shingles(hashes: np.ndarray, owners: np.ndarray, rank: np.ndarray):
    """Shingles of each text without repeats, in order of (rank, hash)."""
    order = np.lexsort((hashes, owners * 256 + rank))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new]


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def count_classes(counts: np.ndarray) -> np.ndarray:
    """Four classes to each doubling of a count."""
    return np.minimum(np.floor(4 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def shingle_counts(texts: DataFrame, scratch: Scratch) -> np.ndarray:
    """Class of the number of documents with a shingle, per cell of the sketch."""

    def count(batches):
        shingler, cells = Shingler(), np.zeros(CELLS, np.uint32)
        for part in text_slices(batches):
            hashes, owners = shingler.shingles(part.column("text").to_pylist())
            hashes, _ = distinct_shingles(hashes, owners, np.zeros(len(hashes), np.int64))
            cells += np.bincount(cells_of(hashes), minlength=CELLS).astype(np.uint32)
        group = TaskContext.get().partitionId() // FAN
        used = [b for b in range(CELLS // BLOCK) if cells[b * BLOCK : (b + 1) * BLOCK].any()]
        held = [
            pa.compress(cells[b * BLOCK : (b + 1) * BLOCK].astype("<i8").tobytes(), "zstd", asbytes=True)
            for b in used
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([group] * len(used), pa.int64()), pa.array(held, pa.binary())],
            names=["block", "group", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for raw in table["counts"]:
            total += np.frombuffer(pa.decompress(raw.as_py(), BLOCK * 8, "zstd", asbytes=True), "<i8")
        return pa.table(
            {
                "block": table["block"][:1],
                "group": pa.array([table["group"][0].as_py() // FAN], pa.int64()),
                "counts": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary()),
            }
        )

    kind = "block long, group long, counts binary"
    rows = texts.select("text").mapInArrow(count, kind)
    level = 0
    while True:  # each level sums up to FAN rows of a block in one group
        rows = scratch.table(rows.groupBy("block", "group").applyInArrow(add, kind), f"counts_{level}")
        if (rows.agg(F.max("group")).first()[0] or 0) == 0 and level:
            break
        level += 1
    out = np.zeros(CELLS, np.int64)
    for row in rows.toLocalIterator():  # CELLS / BLOCK rows
        b = row["block"]
        out[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(
            pa.decompress(row["counts"], BLOCK * 8, "zstd", asbytes=True), "<i8"
        )
    return count_classes(out)


def prefix_sizes(n: np.ndarray, per_cent: int) -> np.ndarray:
    """How many shingles of a set of n any partner must share one of."""
    return np.where(n > 0, n - -(-per_cent * n // 100) + 1, 0)


FEATURES = "doc_id long, text_key binary, set_key binary, n_shingles long, prefix array<long>, parts binary"


def set_features(texts: DataFrame, classes, per_cent: int) -> DataFrame:
    """Digest and size of each set, its prefix, and counts per class of hashes (null where
    they exceed 16 bits)."""

    def run(batches):
        shingler, rank = Shingler(), classes.value
        for part in text_slices(batches):
            raw = part.column("text").to_pylist()
            hashes, owners = shingler.shingles(raw)
            hashes, owners = distinct_shingles(hashes, owners, rank[cells_of(hashes)].astype(np.int64))
            n = np.bincount(owners, minlength=len(raw))
            stops = np.cumsum(n)
            starts = stops - n
            keys = [
                hashlib.blake2b(hashes[a:b].data, digest_size=16).digest()
                for a, b in zip(starts.tolist(), stops.tolist(), strict=True)
            ]
            sizes = prefix_sizes(n, per_cent)
            inside = np.arange(len(hashes)) - starts[owners] < sizes[owners]
            cells = np.bincount(owners * CLASSES + (hashes & U(CLASSES - 1)).astype(np.int64), minlength=len(raw) * CLASSES)
            cells = cells.reshape(-1, CLASSES)
            parts = [c.astype("<u2").tobytes() if c.max() < 1 << 16 else None for c in cells]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array(keys, pa.binary()),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                        pa.array(hashes[inside].view(np.int64), pa.int64()),
                    ),
                    pa.array(parts, pa.binary()),
                ],
                names=["doc_id", "text_key", "set_key", "n_shingles", "prefix", "parts"],
            )

    return texts.mapInArrow(run, FEATURES)


def suffices(bound: Column, n_a: Column, n_b: Column, per_cent: int) -> Column:
    """Whether sets that share ``bound`` shingles at most can reach the similarity."""
    return (100 + per_cent) * bound >= per_cent * (n_a + n_b)


def may_link(a: Column, b: Column, per_cent: int) -> Column:
    """Length and position of a shared shingle; both sides have ``n`` and ``pos``."""
    least = F.least(a["n"], b["n"])
    return suffices(least, a["n"], b["n"], per_cent) & suffices(
        F.least(a["n"] - a["pos"], b["n"] - b["pos"]), a["n"], b["n"], per_cent
    )


def suffix_filter(pairs: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """Distinct pairs that counts per class of hashes do not rule out."""

    def side(name):
        return nodes.select(
            F.col("id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("parts").alias(f"parts_{name}")
        )

    def run(batches):
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            both = np.flatnonzero(
                column["parts_a"].is_valid().to_numpy(zero_copy_only=False)
                & column["parts_b"].is_valid().to_numpy(zero_copy_only=False)
            )
            keep = np.ones(batch.num_rows, bool)
            if len(both):
                a, b = (
                    np.frombuffer(b"".join(column[c].take(pa.array(both)).to_pylist()), "<u2").reshape(-1, CLASSES)
                    for c in ("parts_a", "parts_b")
                )
                sizes = sum(column[c].to_numpy(zero_copy_only=False)[both] for c in ("n_a", "n_b"))
                keep[both] = (100 + per_cent) * np.minimum(a, b).sum(1, dtype=np.int64) >= per_cent * sizes
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([column["a"].filter(keep), column["b"].filter(keep)], names=["a", "b"])

    return (
        pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")
    )


def _star_pairs(members: DataFrame, per_cent: int) -> DataFrame:
    """Each member with the best-scored member of each of its buckets."""
    return members.filter(F.col("id") != F.col("centre.id")).filter(
        may_link(F.struct("n", "pos"), F.col("centre"), per_cent)
    ).select(F.col("id").alias("a"), F.col("centre.id").alias("b"))


def _tile_pairs(table: pa.Table, per_cent: int) -> pa.Table:
    """Open pairs of one tile of a large bucket: different components, length, position."""
    column = {c: table[c].to_numpy() for c in ("id", "n", "pos", "component", "centre", "chunk", "lo", "hi")}
    left = np.flatnonzero(column["chunk"] == column["lo"])
    right = np.flatnonzero(column["chunk"] == column["hi"])
    same = column["lo"][0] == column["hi"][0]
    ids, n, component = column["id"], column["n"], column["component"]
    rest = n - column["pos"]
    right = right[ids[right] != column["centre"][right]]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left[ids[left] != column["centre"][left]]:
        bound = np.minimum(np.minimum(rest[right], rest[i]), np.minimum(n[right], n[i]))
        open_ = (component[right] != component[i]) & ((100 + per_cent) * bound >= per_cent * (n[right] + n[i]))
        if same:
            open_ &= ids[right] > ids[i]
        other = ids[right[open_]]
        found_a.append(np.minimum(other, ids[i]))
        found_b.append(np.maximum(other, ids[i]))
    return pa.table({"a": pa.array(np.concatenate(found_a), pa.int64()), "b": pa.array(np.concatenate(found_b), pa.int64())})


def _cross_pairs(members: DataFrame, labels: DataFrame, scratch: Scratch, per_cent: int) -> DataFrame:
    """Pairs of different components that meet in a bucket, without those of its centre."""
    labelled = members.join(labels, "id").withColumn("centre", F.col("centre.id"))
    mixed = (
        labelled.groupBy("token")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .filter("least <> most")
        .select("token")
    )
    left = scratch.table(labelled.join(mixed, "token"), "mixed")
    one = F.col("one")
    few = (
        left.filter((F.col("size") <= BUCKET) & (F.col("id") != F.col("centre")))
        .groupBy("token")
        .agg(F.collect_list(F.struct("id", "component", "n", "pos")).alias("held"))
        .select("held", F.explode("held").alias("one"))
        .select(
            one["id"].alias("a"),
            F.explode(
                F.filter(
                    "held",
                    lambda x: (x["id"] > one["id"])
                    & (x["component"] != one["component"])
                    & may_link(one, x, per_cent),
                )
            ).alias("other"),
        )
        .select("a", F.col("other.id").alias("b"))
    )
    chunks = F.ceil(F.col("size") / TILE).cast("int")
    many = (
        left.filter(F.col("size") > BUCKET)
        .withColumn("chunk", F.pmod(F.hash("id"), chunks))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
        .drop("other")
        .groupBy("token", "lo", "hi")
        .applyInArrow(lambda table: _tile_pairs(table, per_cent), "a long, b long")
    )
    return few.unionByName(many)


def shingle_join(
    documents: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: shingles of its set and the smallest key that links reach."""
    spark = documents.sparkSession
    per_cent = round(100 * similarity)
    if not 1 <= per_cent <= 100:
        raise ValueError("similarity must lie between 0.01 and 1")
    texts = keyed_texts(documents, id_col, text_col)
    with Scratch(spark) as scratch:
        classes = spark.sparkContext.broadcast(shingle_counts(texts, scratch))
        found = scratch.table(set_features(texts, classes, per_cent), "features")
        one = F.struct("doc_id", "text_key", "n_shingles", "prefix", "parts")
        nodes = scratch.table(
            found.filter("n_shingles > 0 and doc_id is not null")
            .groupBy("set_key")
            .agg(F.min_by(one, F.struct("doc_id", "text_key")).alias("x"))
            .select("set_key", "x.*")
            .withColumn("id", F.monotonically_increasing_id()),
            "nodes",
        )
        postings = nodes.select(
            "id", F.col("n_shingles").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")
        )
        sizes = postings.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
        members = scratch.table(postings.join(sizes, "token"), "postings")
        scores = members.groupBy("id").agg(F.sum("size").alias("score"))
        ranked = members.join(scores, "id")
        centres = ranked.groupBy("token").agg(
            F.max(F.struct("score", (-F.col("id")).alias("down"), "n", "pos")).alias("best")
        ).select("token", F.struct((-F.col("best.down")).alias("id"), "best.n", "best.pos").alias("centre"))
        members = scratch.table(members.join(centres, "token"), "members")

        def links(pairs, name):
            open_ = scratch.table(suffix_filter(pairs, nodes, per_cent), f"pairs_{name}")
            return scratch.table(confirm(open_, nodes, texts, similarity), f"links_{name}")

        first = links(_star_pairs(members, per_cent), "1")
        labels = scratch.table(
            members.select("id").distinct().join(components(first, scratch, "round_1"), "id", "left").select(
                "id", F.coalesce("component", "id").alias("component")
            ),
            "labels",
        )
        second = links(_cross_pairs(members, labels, scratch, per_cent), "2")
        reached = components(first.unionByName(second), scratch, "round_2")
        placed = nodes.select("id", "set_key", "doc_id").join(reached, "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )
        heads = placed.groupBy("component").agg(F.min("doc_id").alias("head"))
        placed = placed.join(heads, "component").select("set_key", "head")
        linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        return scratch.result(
            found.select("doc_id", "n_shingles", "set_key")
            .join(placed, "set_key", "left")
            .select(
                F.col("doc_id").alias(id_col),
                "n_shingles",
                F.when(linked, F.col("head")).otherwise(F.col("doc_id")).alias("component_id"),
            )
        )


def op12_shingle_join(spark, folder):
    return shingle_join(spark.read.parquet(f"{folder}/documents.parquet"))
