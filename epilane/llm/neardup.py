"""Near-duplicate documents by HyperMinHash registers, confirmed on full shingle sets.

A register holds the leading zeros of its least hash and the bits after them (6 + 10
bits). Sets of ``SMALL`` shingles and more fill 8 rows of 16 registers, one hash per row;
small sets fill 128 registers with one hash each; sizes that can be similar across that
line get both. Four registers make a band key, so two sets of similarity s share a band
with probability 1 - (1 - s**4)**32, over 0.999994 from 0.75 on.

Candidates are searched without all pairs of a band bucket:

1. Equal texts are one node. A node scores the summed sizes of its buckets; each node is
   compared with the best-scored node that it meets, which for a group of copies is the
   original. Confirmed links join nodes to components.
2. Nodes of a large group with one centre are compared set by set, tile by tile, where
   they lie in different components; only links leave a tile.
3. In buckets that still hold several components, the other pairs of different components
   are compared by registers (large buckets tile by tile), and pairs whose
   collision-corrected estimate is within five deviations of the threshold are confirmed.

Confirmation cuts the texts anew and compares the whole sets.

Cases: a null or wordless text has no shingles and is linked with nothing; a null key
takes no part, has no component and is kept; several texts under one key are nodes of
their own, and of those in one component that with the least digest is kept; repeated rows and ties are copies; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.llm.words import WordHasher, mix, release
from epilane.session import Scratch

WORDS = 5
REGISTERS = 128
ROWS = 4  # registers per band
LARGE_HASHES = 8
SMALL, SMALL_TOP, LARGE_LOW = 64, 85, 48  # sizes differ by 3/4 at most across 64
MANTISSA = 10
DEVIATIONS = 5
BUCKET_PAIRS = 32  # up to this size a bucket's pairs are listed in SQL
TILE = 256
STAR = 256  # members per task of one centre

# Registers travel as the long integers of the bands, four registers each.
FEATURES = (
    "doc_id long, text_key binary, n_shingles long, large array<long>, small array<long>"
)
BASE_OWNER = 0xD6E8FEB86659FD93
U = np.uint64


class Shingler:
    """Shingle hashes of many texts at once."""

    def __init__(self):
        self.hasher = WordHasher(fold=True)

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every shingle, in order, with repeats."""
        _, _, _, word, owner = self.hasher.words(texts)
        sizes = np.bincount(owner, minlength=len(texts))
        chain = mix(word + U(1))
        # Windows of 1 .. WORDS words; the last is taken, or the longest of a short text.
        found, owners = [], []
        for k in range(1, WORDS + 1):
            if k > 1:
                chain = mix(chain[:-1] * U(31) + word[k - 1 :]) if len(chain) else chain
            here = owner[: len(chain)]
            if k < WORDS:
                starts = np.cumsum(sizes) - sizes
                at = starts[sizes == k]
                found.append(chain[at])
                owners.append(here[at])
            elif len(chain):
                whole = here == owner[WORDS - 1 :]
                found.append(chain[whole])
                owners.append(here[whole])
        hashes, owners = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return hashes[order], owners[order]

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        hashes, owners = self.shingles(texts)
        cuts = np.searchsorted(owners, np.arange(len(texts) + 1))
        return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def registers(hashes, owners, n_texts: int, n_hashes: int) -> np.ndarray:
    """16-bit registers per text: leading zeros and mantissa of each least hash; 0 if empty.

    Every hash function deals the shingles to ``REGISTERS / n_hashes`` registers.
    """
    width = REGISTERS // n_hashes
    shift = width.bit_length() - 1
    random = np.random.default_rng(97 + n_hashes)
    factors = random.integers(0, 1 << 63, n_hashes, dtype=np.uint64) * U(2) + U(1)
    least = np.full((n_texts, n_hashes, width), U(0xFFFFFFFFFFFFFFFF))
    flat = least.reshape(-1)
    for k, factor in enumerate(factors):
        x = mix(hashes * factor + U(k))
        slot = (owners * n_hashes + k) * width
        if shift:
            slot = slot + (x >> U(64 - shift)).astype(np.int64)
            x = x << U(shift)
        np.minimum.at(flat, slot, x >> U(1))
    empty = least == U(0xFFFFFFFFFFFFFFFF)
    least = np.where(empty, U(1), np.maximum(least, U(1)))
    # Values have 63 bits; frexp would round, so the bit length is taken by halves.
    length = np.zeros(least.shape, np.uint64)
    rest = least.copy()
    for half in (32, 16, 8, 4, 2, 1):
        big = rest >= (U(1) << U(half))
        length += np.where(big, U(half), U(0))
        rest = np.where(big, rest >> U(half), rest)
    zeros = np.minimum(U(62) - length, U(62))
    mantissa = ((least << (U(63) - length)) >> U(63 - MANTISSA)) & U((1 << MANTISSA) - 1)
    value = np.where(empty, U(0), ((zeros + U(1)) << U(MANTISSA)) | mantissa)
    return value.astype("<u2").reshape(n_texts, REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b, width: int) -> np.ndarray:
    """Jaccard estimate of register rows, without the expected chance collisions."""
    equal = ((a == b) & (a > 0)).sum(1)
    used = np.maximum(((a > 0) | (b > 0)).sum(1), 1)
    level = 2.0 ** -np.arange(64)

    def share(n):
        load = np.asarray(n, float)[:, None] / width
        return np.exp(-load * level / 2) - np.exp(-load * level)

    chance = (share(n_a) * share(n_b)).sum(1) / (1 << MANTISSA)
    return (equal / used - chance) / (1 - chance)


def text_slices(batches, limit: int = 2 << 20):
    """Parts of the batches with at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        release()
        sizes = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _features(batches):
    shingler = Shingler()
    for part in text_slices(batches):
        texts = part.column("text").to_pylist()
        hashes, owners = shingler.shingles(texts)
        order = np.argsort(mix(hashes ^ (owners.astype(np.uint64) * U(BASE_OWNER))), kind="stable")
        tagged_h, tagged_o = hashes[order], owners[order]
        new = np.ones(len(order), bool)
        new[1:] = (tagged_h[1:] != tagged_h[:-1]) | (tagged_o[1:] != tagged_o[:-1])
        n = np.bincount(tagged_o[new], minlength=len(texts))
        is_large, is_small = n >= LARGE_LOW, (n > 0) & (n <= SMALL_TOP)
        columns = []
        for held, n_hashes in ((is_large, LARGE_HASHES), (is_small, REGISTERS)):
            mine = held[owners]
            place = np.cumsum(held) - 1
            rows = registers(hashes[mine], place[owners[mine]], int(held.sum()), n_hashes)
            offsets = np.concatenate([[0], np.cumsum(held)]) * (REGISTERS // ROWS)
            columns.append(
                pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()),
                    pa.array(rows.reshape(-1).view("<i8"), pa.int64()),
                    mask=pa.array(~held),
                )
            )
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), *columns],
            names=["doc_id", "text_key", "n_shingles", "large", "small"],
        )


def _register_rows(column: pa.Array) -> np.ndarray:
    """Register rows of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, "<i8").view("<u2").reshape(-1, REGISTERS)


def keyed_texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key, text in bytes and its digest."""
    return documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"),
    ).withColumn("text_key", F.unhex(F.md5("text")))


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Text digest, size of the set and registers per row."""
    return keyed_texts(documents, id_col, text_col).mapInArrow(_features, FEATURES)


def _close(batches, least: float):
    """Pairs whose estimate, or one of two, is not below ``least``."""
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        keep = np.zeros(batch.num_rows, bool)
        n_a = columns["n_a"].to_numpy(zero_copy_only=False)
        n_b = columns["n_b"].to_numpy(zero_copy_only=False)
        for name, width in (("large", REGISTERS // LARGE_HASHES), ("small", 1)):
            a, b = columns[f"{name}_a"], columns[f"{name}_b"]
            both = np.flatnonzero(
                a.is_valid().to_numpy(zero_copy_only=False)
                & b.is_valid().to_numpy(zero_copy_only=False)
            )
            if len(both):
                rows = [_register_rows(x.take(pa.array(both))) for x in (a, b)]
                keep[both] |= estimate(*rows, n_a[both], n_b[both], width) >= least
        yield pa.RecordBatch.from_arrays(
            [columns["a"].filter(pa.array(keep)), columns["b"].filter(pa.array(keep))],
            names=["a", "b"],
        )


def close_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose register estimate does not rule out the similarity."""
    least = similarity - DEVIATIONS * (similarity * (1 - similarity) / REGISTERS) ** 0.5

    def side(name):
        return nodes.select(
            F.col("id").alias(name),
            F.col("n_shingles").alias(f"n_{name}"),
            F.col("large").alias(f"large_{name}"),
            F.col("small").alias(f"small_{name}"),
        )

    fits = (F.col("n_a") >= similarity * F.col("n_b")) & (F.col("n_b") >= similarity * F.col("n_a"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .filter(fits)
        .mapInArrow(lambda batches: _close(batches, least), "a long, b long")
    )


def confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose whole shingle sets reach the similarity.

    Each centre ``b`` meets its partners in groups of about ``STAR``; only texts that occur
    in a pair are cut.
    """
    per_cent = round(100 * similarity)
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups"))
    members = pairs.join(sizes, "b").select(
        F.col("a").alias("id"), "b", F.pmod(F.hash("a"), "groups").alias("group"), F.lit(1).alias("place")
    )
    centres = sizes.select(
        F.col("b").alias("id"),
        "b",
        F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
        F.lit(0).alias("place"),
    )
    wanted = members.unionByName(centres).join(nodes.select("id", "doc_id", "text_key"), "id")
    rows = (
        texts.join(wanted, ["doc_id", "text_key"])
        .repartition("b", "group")
        .sortWithinPartitions("b", "group", "place")
        .select("b", "group", "place", "id", "text")
    )

    def run(batches):
        shingler, centre, held = Shingler(), None, None
        for part in text_slices(batches):
            b, group, place, ids, texts = (c.to_pylist() for c in part.columns)
            left, right = [], []
            for k, (key, one) in enumerate(zip(zip(b, group, strict=True), shingler.sets(texts), strict=True)):
                if place[k] == 0:
                    centre, held = key, one
                    continue
                if key != centre:
                    raise ValueError("a group lacks its centre")
                at = np.minimum(np.searchsorted(held, one), len(held) - 1)
                common = int((held[at] == one).sum())
                if 100 * common >= per_cent * (len(held) + len(one) - common):
                    left.append(ids[k])
                    right.append(b[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Node and smallest node reachable, for all nodes of ``links`` (a, b).

    Large-star and small-star steps in turn until nothing changes.
    """

    def star(edges, large):
        if large:
            around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            around = edges.select(
                F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
            )
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = around.join(least, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return out.filter("a <> b").distinct()

    def state(edges):
        row = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        return tuple(row)

    edges = scratch.table(links.filter("a <> b").select("a", "b").distinct(), f"{name}_0")
    before, step = state(edges), 0
    while before[0]:
        step += 1
        edges = scratch.table(star(star(edges, True), False), f"{name}_{step}")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _tile_sides(table: pa.Table, names: tuple[str, ...]):
    column = {c: table[c].to_numpy(zero_copy_only=False) for c in names}
    left = np.flatnonzero(column["chunk"] == column["lo"])
    right = np.flatnonzero(column["chunk"] == column["hi"])
    return column, left, right


def _pairs_table(found_a: list, found_b: list) -> pa.Table:
    none = [np.zeros(0, np.int64)]
    return pa.table(
        {
            "a": pa.array(np.concatenate(none + found_a), pa.int64()),
            "b": pa.array(np.concatenate(none + found_b), pa.int64()),
        }
    )


def _tile_pairs(table: pa.Table) -> pa.Table:
    """Pairs of one tile of a large bucket that are still to be judged."""
    column, left, right = _tile_sides(
        table, ("id", "component", "cluster", "big", "chunk", "lo", "hi")
    )
    row = _register_rows(table["registers"].combine_chunks())
    least = float(table["least"][0].as_py())
    ids, cluster, big = column["id"], column["cluster"], column["big"].astype(bool)
    found_a, found_b = [], []
    for i in left:
        open_ = column["component"][right] != column["component"][i]
        open_ &= ~((cluster[right] == cluster[i]) & big[i])
        open_ &= (cluster[right] != ids[i]) & (ids[right] != cluster[i])
        if column["lo"][0] == column["hi"][0]:
            open_ &= ids[right] > ids[i]
        other = right[open_]
        used = np.maximum(((row[other] > 0) | (row[i] > 0)).sum(1), 1)
        share = ((row[other] == row[i]) & (row[i] > 0)).sum(1) / used
        other = other[share >= least]
        found_a.append(np.full(len(other), ids[i]))
        found_b.append(ids[other])
    return _pairs_table(found_a, found_b)


def _tile_links(table: pa.Table, per_cent: int) -> pa.Table:
    """Links of one tile of a large cluster, from the whole sets, between components."""
    column, left, right = _tile_sides(table, ("id", "component", "chunk", "lo", "hi"))
    sets = [np.frombuffer(x.as_py(), "<u8") for x in table["shingles"]]
    sizes = np.array([len(x) for x in sets], np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(int(number.max()) + 1, bool)
    found_a, found_b = [], []
    for i in left:
        open_ = column["component"][right] != column["component"][i]
        if column["lo"][0] == column["hi"][0]:
            open_ &= column["id"][right] > column["id"][i]
        if not open_.any():
            continue
        mine = number[starts[i] : starts[i] + sizes[i]]
        held[mine] = True
        common = np.add.reduceat(held[number], starts, dtype=np.int64)
        held[mine] = False
        close = 100 * common >= per_cent * (sizes + sizes[i] - common)
        other = right[open_ & close[right]]
        found_a.append(np.full(len(other), column["id"][i]))
        found_b.append(column["id"][other])
    return _pairs_table(found_a, found_b)


def _tiled(rows: DataFrame, size: Column, tile: int) -> DataFrame:
    """Rows once per tile they belong to: every pair of chunks of a group is a tile."""
    chunks = F.ceil(size / tile).cast("int")
    return (
        rows.withColumn("chunk", F.pmod(F.hash("id"), chunks))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
        .drop("other")
    )


def _cluster_links(labelled, nodes, texts, similarity, scratch) -> DataFrame:
    """Links between components within large clusters (one centre), tile by tile."""
    inside = labelled.filter("big")
    mixed = (
        inside.groupBy("cluster")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
        .filter("lo <> hi")
        .select("cluster", "size")
    )
    wanted = inside.join(mixed, "cluster").join(nodes.select("id", "doc_id", "text_key"), "id")

    def cut(batches):
        shingler = Shingler()
        for part in text_slices(batches):
            sets = shingler.sets(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("id", "cluster", "component", "size")),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                names=["id", "cluster", "component", "size", "shingles"],
            )

    sets = scratch.table(
        texts.join(wanted, ["doc_id", "text_key"])
        .select("id", "cluster", "component", "size", "text")
        .mapInArrow(cut, "id long, cluster long, component long, size long, shingles binary"),
        "cluster_sets",
    ).dropDuplicates(["id"])
    per_cent = round(100 * similarity)
    return (
        _tiled(sets, F.col("size"), TILE // 2)
        .groupBy("cluster", "lo", "hi")
        .applyInArrow(lambda table: _tile_links(table, per_cent), "a long, b long")
    )


def _cross_pairs(members, labels, nodes, similarity, scratch) -> DataFrame:
    """Pairs of nodes that share a bucket, lie in different components and have neither
    been compared as member and centre nor lie in one large cluster."""
    labelled = members.join(labels, "id")
    mixed = (
        labelled.groupBy("band", "key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .filter("lo <> hi")
        .select("band", "key")
    )
    left = scratch.table(labelled.join(mixed, ["band", "key"]), "mixed")
    few = (
        left.filter(F.col("size") <= BUCKET_PAIRS)
        .groupBy("band", "key")
        .agg(F.collect_list(F.struct("id", "component", "cluster", "big")).alias("held"))
        .select("held", F.explode("held").alias("one"))
        .select(
            F.col("one.id").alias("a"),
            F.explode(
                F.filter(
                    "held",
                    lambda x: (x["id"] > F.col("one.id"))
                    & (x["component"] != F.col("one.component"))
                    & ~(x["big"] & (x["cluster"] == F.col("one.cluster")))
                    & (x["cluster"] != F.col("one.id"))
                    & (x["id"] != F.col("one.cluster")),
                )
            ).alias("other"),
        )
        .select("a", F.col("other.id").alias("b"))
    )
    least = similarity - DEVIATIONS * (similarity * (1 - similarity) / REGISTERS) ** 0.5
    many = (
        _tiled(left.filter(F.col("size") > BUCKET_PAIRS), F.col("size"), TILE)
        .join(nodes.select("id", "large", "small"), "id")
        .withColumn(
            "registers",
            F.when(F.col("band") < REGISTERS // ROWS, F.col("large")).otherwise(F.col("small")),
        )
        .drop("large", "small")
        .withColumn("least", F.lit(least))
        .groupBy("band", "key", "lo", "hi")
        .applyInArrow(_tile_pairs, "a long, b long")
    )
    return few.unionByName(many).distinct()


def _numbered(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Distinct texts with a number ``id`` of their own, and whether some share their key.

    The key is the number of its text with the least digest; others are numbered by
    fingerprint, anew while one of them is taken.
    """
    table = scratch.table(texts, "texts")
    least = table.groupBy("doc_id").agg(F.min("text_key").alias("least"), F.count("*").alias("n"))
    several = scratch.table(least.filter("n > 1").drop("n"), "several")
    if several.isEmpty():
        return table.withColumn("id", F.col("doc_id")), False
    salt = 0
    while True:
        number = F.when(
            F.coalesce(F.col("least") == F.col("text_key"), F.lit(True)), F.col("doc_id")
        ).otherwise(F.xxhash64("text_key", F.lit(salt)))
        nodes = scratch.table(
            table.join(several, "doc_id", "left").withColumn("id", number).drop("least"), f"nodes_{salt}"
        )
        if nodes.groupBy("id").count().filter("count > 1").isEmpty():
            return nodes, True
        salt += 1


def near_duplicates(
    documents: DataFrame, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: shingles of its set, smallest key of its component, kept or not.

    ``text_key`` is the MD5 digest of the text.
    """
    with Scratch(documents.sparkSession) as scratch:
        found = scratch.table(features(documents, id_col, text_col), "features")
        one = F.struct("doc_id", "text_key", "n_shingles", "large", "small")
        distinct = (
            found.filter("n_shingles > 0 and doc_id is not null")
            .groupBy("text_key")
            .agg(F.min_by(one, "doc_id").alias("x"))
            .select("x.*")
        )
        nodes, shared = _numbered(distinct, scratch)
        half = REGISTERS // ROWS
        banded = (
            nodes.select("id", F.posexplode("large").alias("band", "key"))
            .unionByName(
                nodes.select("id", F.posexplode("small").alias("band", "key")).withColumn(
                    "band", F.col("band") + half
                )
            )
        )
        sizes = banded.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
        members = scratch.table(banded.join(sizes, ["band", "key"]), "members")
        scores = members.groupBy("id").agg(F.sum("size").alias("score"))
        scored = members.join(scores, "id")
        rank = F.struct(F.col("score"), (-F.col("id")).alias("down"))
        best = scored.groupBy("band", "key").agg(F.max(rank).alias("best"))
        stars = scratch.table(
            members.join(best, ["band", "key"])
            .filter(F.col("id") != -F.col("best.down"))
            .groupBy("id")
            .agg(F.max("best").alias("best"))
            .select(F.col("id").alias("a"), (-F.col("best.down")).alias("b")),
            "stars",
        )
        texts = keyed_texts(documents, id_col, text_col)
        first = scratch.table(
            confirm(
                scratch.table(close_pairs(stars, nodes, similarity), "close_1"), nodes, texts, similarity
            ),
            "links_1",
        )
        comps = components(first, scratch, "round_1")
        big = stars.groupBy("b").agg((F.count("*") > BUCKET_PAIRS).alias("big"))
        labels = scratch.table(
            members.select("id")
            .distinct()
            .join(comps, "id", "left")
            .join(stars.join(big, "b").select(F.col("a").alias("id"), F.col("b").alias("cluster"), "big"), "id", "left")
            .select(
                "id",
                F.coalesce("component", "id").alias("component"),
                F.coalesce("cluster", F.lit(-(1 << 63))).alias("cluster"),
                F.coalesce("big", F.lit(False)).alias("big"),
            ),
            "labels",
        )
        inner = scratch.table(_cluster_links(labels, nodes, texts, similarity, scratch), "links_0")
        cross = _cross_pairs(members, labels, nodes, similarity, scratch)
        second = scratch.table(
            confirm(
                scratch.table(close_pairs(cross, nodes, similarity), "close_2"), nodes, texts, similarity
            ),
            "links_2",
        )
        comps = components(first.unionByName(inner).unionByName(second), scratch, "round_2")
        grouped = nodes.select("text_key", "id", "doc_id").join(comps, "id", "left").select(
            "text_key", "doc_id", F.coalesce("component", "id").alias("component")
        )
        chosen = F.lit(True)
        if shared:
            # Numbers of texts that share their key are no keys: name components anew.
            heads = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("head"))
            grouped = grouped.join(heads, "component").select(
                "text_key",
                F.col("head.doc_id").alias("component"),
                (F.col("text_key") == F.col("head.text_key")).alias("first"),
            )
            chosen = F.coalesce("first", F.lit(True))
        else:
            grouped = grouped.drop("doc_id")
        linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        component = F.when(linked, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
        return scratch.result(
            found.select("doc_id", "n_shingles", "text_key")
            .join(grouped, "text_key", "left")
            .select(
                F.col("doc_id").alias(id_col),
                "n_shingles",
                component.alias("component_id"),
                F.coalesce((F.col("doc_id") == component) & chosen, F.lit(True)).alias("kept"),
                "text_key",
            )
        )


def drop_near_duplicates(
    documents: DataFrame, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row, all columns, of each component: that with the smallest key.

    Of rows that repeat key and text one stays; rows with a null key all stay.
    """
    verdict = near_duplicates(documents, similarity, id_col, text_col)
    taken = {c.lower() for c in documents.columns}
    names = [f"_{n}" for n in ("key", "digest", "mark")]
    while taken & set(names):
        names = [f"_{n}" for n in names]
    key, digest, mark = names
    keepers = (
        verdict.filter(F.col("kept") & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias(key), F.col("text_key").alias(digest))
        .distinct()
        .withColumn(mark, F.lit(True))
    )
    marked = documents.withColumns(
        {
            key: F.col(id_col).cast("long"),
            digest: F.unhex(F.md5(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8"))),
        }
    )
    named = marked.filter(F.col(key).isNotNull()).join(keepers, [key, digest])
    kept = named.dropDuplicates([key, digest]).select(*documents.columns)
    return kept.unionByName(documents.filter(F.col(id_col).isNull()))


def op6_near_dup(spark, folder):
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).drop("text_key")
