"""Reading by byte ranges: block-gzipped text, FASTA by index, ordered parts."""

import gzip
import random

import pytest

from epilane.operators import regions
from epilane.operators import segments as segment_ops
from epilane.sources import alignments, blocks, lines, parts, sequences, sinks, store
from epilane.sources.ranges import first_break, whole_lines


def block_file(path, text, member=300):
    with open(path, "wb") as out:
        for at in range(0, len(text), member):
            out.write(blocks.pack_member(text[at : at + member]))
        out.write(blocks.LAST)
    return str(path)


def random_text(seed, n, breaks=(b"\n",)):
    rng = random.Random(seed)
    out = b""
    for i in range(n):
        out += bytes(rng.choice(b"abcACGT\t") for _ in range(rng.choice([0, 1, 5, 40, 400]))) + rng.choice(breaks)
    return out


@pytest.mark.parametrize("breaks", [(b"\n",), (b"\r\n",), (b"\n", b"\r\n", b"\r")])
def test_lines_of_ranges_join_to_the_text(breaks):
    text = random_text(3, 60, breaks) + b"end"
    for size in (1, 2, 7, 50, 333):
        cut = [text[at : at + size] for at in range(0, len(text), size)]
        got = b"".join(whole_lines(c, iter(cut[k + 1 :]), k == 0)[1] for k, c in enumerate(cut))
        assert got == text
        starts = 0
        for k, c in enumerate(cut):
            at, own = whole_lines(c, iter(cut[k + 1 :]), k == 0)
            if own:
                assert k * size + at == starts
            starts += len(own)
    assert first_break(b"ab", 0) is None


def test_file_of_many_members_is_read_by_many_tasks(spark, tmp_path):
    text = random_text(5, 900)
    path = block_file(tmp_path / "a.txt.gz", text, member=len(text) // 210)
    plain = str(tmp_path / "plain.txt")
    open(plain, "wb").write(text)
    index = blocks.member_index(spark, path, range_bytes=700).orderBy("offset").collect()
    assert len(index) > 200 and sum(r["text_size"] for r in index) == len(text)
    assert all(a["offset"] + a["size"] == b["offset"] for a, b in zip(index[:-1], index[1:]))
    for size in (500, 4000, 1 << 24):
        read = lines.numbered_lines(spark, path, range_bytes=size)
        rows = read.orderBy("line_no").collect()
        expected = lines.numbered_lines(spark, plain).orderBy("line_no").collect()
        assert [r["line"] for r in rows] == [r["line"] for r in expected]
        assert len({r["line_no"] for r in rows}) == len(rows)
        tasks = len({r["line_no"] >> 32 for r in rows})
        assert tasks > 20 if size == 500 else tasks >= 1
    assert gzip.decompress(open(path, "rb").read()) == text
    both = lines.numbered_lines(spark, [path, plain], range_bytes=900).collect()
    assert len({r["line_no"] for r in both}) == len(both) == 2 * len(rows)


def test_magic_inside_a_member_is_no_member(spark, tmp_path):
    rng = random.Random(8)
    noise = b"".join(blocks.MAGIC + bytes(rng.randrange(256) for _ in range(9)) + b"\n" for _ in range(400))
    path = str(tmp_path / "noise.gz")
    with open(path, "wb") as out:
        for at in range(0, len(noise), 500):
            member = noise[at : at + 500]
            # Stored, so that the magic stands in the file as it is.
            packed = blocks.pack_member(member)
            out.write(packed)
    rows = blocks.member_index(spark, path, range_bytes=300).collect()
    assert len(rows) == -(-len(noise) // 500)
    got = [r["value"] for r in blocks.block_lines(spark, [(f"file://{path}", len(open(path, "rb").read()))], 300).orderBy("line_no").collect()]
    assert len(got) == len(noise.splitlines())


def test_sam_by_ranges_equals_plain_reading(spark, tmp_path):
    rows = "".join(f"r{i}\t0\tchr{i % 3}\t{i + 1}\t9\t4M\t*\t0\t0\tACGT\tIIII\tXM:Z:{'z' * (i % 5)}\n" for i in range(500))
    text = "@HD\tVN:1.6\n@SQ\tSN:chr0\tLN:9\n" + rows
    path = block_file(tmp_path / "a.sam.gz", text.encode())
    plain = str(tmp_path / "a.sam")
    open(plain, "w").write(text)

    def read(p):
        return [tuple(r)[1:] for r in alignments.read_sam(spark, p).orderBy("line_no").collect()]

    assert read(path) == read(plain)
    assert [r["chrom"] for r in alignments.read_sam_header(spark, path).collect()] == ["chr0"]


def test_other_gzip_and_empty_files(spark, tmp_path):
    path = str(tmp_path / "b.gz")
    open(path, "wb").write(gzip.compress(b"one\ntwo\n"))
    assert [r["line"] for r in lines.numbered_lines(spark, path).collect()] == ["one", "two"]
    empty = block_file(tmp_path / "c.gz", b"")
    assert lines.numbered_lines(spark, empty).collect() == []
    broken = str(tmp_path / "d.gz")
    open(broken, "wb").write(blocks.pack_member(b"a\n") + b"something else" * 9)
    with pytest.raises(Exception, match="no member of a block-gzipped file"):
        lines.numbered_lines(spark, broken).collect()


def fasta(path, sequences_, width=7, end="\n"):
    with open(path, "w", newline="") as out:
        for name, seq in sequences_.items():
            out.write(f">{name} more{end}")
            for at in range(0, len(seq), width):
                out.write(seq[at : at + width] + end)
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_index_and_random_access(spark, tmp_path, end):
    rng = random.Random(4)
    held = {f"c{k}": "".join(rng.choice("ACGTacgt") for _ in range(n)) for k, n in enumerate((500, 7, 0, 61, 2000))}
    path = fasta(tmp_path / "g.fa", held, end=end)
    index = sequences.fasta_index(spark, path, range_bytes=97).cache()
    assert {r["chrom"]: r["length"] for r in index.collect()} == {k: len(v) for k, v in held.items()}
    wanted = [(rng.choice(sorted(held)), s, s + rng.randrange(0, 60)) for s in (rng.randrange(0, 600) for _ in range(150))]
    wanted += [("c0", 0, 500), ("c4", 5, 2500), ("c1", -3, 4), ("none", 1, 2)]
    frame = spark.createDataFrame(wanted, "chrom string, start long, end long")
    got = sequences.read_segments(index, frame, gap=0).collect()
    assert {(r["chrom"], r["start"], r["end"]): r["seq"] for r in got} == {
        (c, s, e): held[c][max(s, 0) : max(e, 0)] for c, s, e in wanted if c in held
    }
    assert all(r["length"] == len(held[r["chrom"]]) for r in got)


def test_only_the_bytes_of_the_segments_are_read(spark, tmp_path):
    path = fasta(tmp_path / "g.fa", {"c": "ACGTT" * 200_000}, width=50)
    index = sequences.fasta_index(spark, path, range_bytes=1 << 18)
    wanted = spark.createDataFrame([("c", k * 90_000, k * 90_000 + 20) for k in range(11)], "chrom string, start long, end long")
    got = sequences.read_segments(index, wanted, gap=100).collect()
    assert all(r["seq"] == "ACGTT" * 4 for r in got)
    assert sum(r["bytes_read"] for r in got) <= 11 * 22
    joined = sequences.read_segments(index, wanted, gap=1 << 20).collect()
    assert {tuple(r)[:4] for r in joined} == {tuple(r)[:4] for r in got}


def test_pieces_of_a_chromosome_in_several_files(spark, tmp_path):
    rng = random.Random(6)
    seq = "".join(rng.choice("ACGT") for _ in range(5000))
    chunks = [("c", at, seq[at : at + 100]) for at in range(0, 5000, 100)] + [("d", 0, "ACGTA")]
    genome = spark.createDataFrame(chunks, "chrom string, offset long, seq string")
    path = str(tmp_path / "out")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_fasta(genome, path, width=20)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    index = sequences.fasta_index(spark, path, pieces=True, range_bytes=256)
    assert index.filter("chrom = 'c'").count() > 1
    wanted = [("c", s, s + n) for s, n in ((0, 5000), (1234, 300), (4990, 40), (99, 2))] + [("d", 1, 3)]
    frame = spark.createDataFrame(wanted, "chrom string, start long, end long")
    whole = {"c": seq, "d": "ACGTA"}
    for r in sequences.read_segments(index, frame).collect():
        assert r["seq"] == whole[r["chrom"]][r["start"] : r["end"]]
    read = sequences.read_fasta(spark, path, chunk_size=64, pieces=True).collect()
    assert "".join(r["seq"] for r in sorted(read, key=lambda r: r["offset"]) if r["chrom"] == "c") == seq
    segs = spark.createDataFrame([("c", 10, 5), ("x", 1, 5), ("d", 3, 9)], "chrom string, pos long, len long")
    got = {(r["chrom"], r["seq"], r["past_end"]) for r in segment_ops.extract_indexed(index, segs).collect()}
    assert got == {("c", seq[10:15], False), ("x", None, None), ("d", "TA", True)}


def test_uneven_lines_fail(spark, tmp_path):
    path = str(tmp_path / "u.fa")
    open(path, "w").write(">a\nACGT\nAC\nACGT\nAC\n")
    with pytest.raises(Exception, match="unequal size"):
        sequences.fasta_index(spark, path).collect()


@pytest.mark.parametrize("name", ["out.gz", "out"])
def test_ordered_parts(spark, tmp_path, name):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.8 else 2, rng.randrange(10**6), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "ord int, pos long, k long").selectExpr(
        "ord", "pos", "k", "concat_ws('\t', ord, pos, k) as value"
    )
    path = str(tmp_path / name)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = parts.write_ordered(frame, ["ord", "pos", "k"], path, header="#head").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    # The hot chromosome is split over parts.
    assert sum(r["first"] is not None and r["first"]["ord"] == 1 for r in manifest) > 1
    assert parts.check_order(spark, path) == len(manifest) - 1
    whole = b""
    for r in sorted(manifest, key=lambda r: r["part"]):
        data = open(f"{path}/{r['file']}", "rb").read()
        assert len(data) == r["bytes"]
        whole += data
    text = gzip.decompress(whole) if name.endswith(".gz") else whole
    expected = ["\t".join(map(str, r)) for r in sorted(rows)]
    assert text.decode().splitlines() == ["#head", *expected]
    read = parts.read_ordered(spark, path).orderBy("place").collect()
    assert [r["place"] for r in read] == list(range(3000))
    assert [r["line"] for r in read] == expected
    with pytest.raises(FileExistsError):
        parts.write_ordered(frame, ["ord"], path)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_stored_counts_are_not_shuffled(spark, tmp_path):
    rng = random.Random(3)
    rows = {(s, f"c{k}", rng.randrange(1, 900_000)) for s in "ab" for k in (1, 2) for _ in range(400)}
    rows |= {(s, "c1", p) for s in "ab" for p in range(261_900, 262_400, 20)}  # over the border of a tile
    frame = spark.createDataFrame(
        [(*r, rng.randrange(1, 40), rng.randrange(0, 9)) for r in sorted(rows)],
        "sample string, chrom string, pos long, meth long, unmeth long",
    )
    name = "stored_counts_test"
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stored = store.store_counts(frame, name, str(tmp_path / "counts"), buckets=5)
        assert exchanges(regions.qualify_sites(frame)) == 1
        assert exchanges(regions.qualify_sites(stored)) == 0
        plain, kept = (regions.cluster_sites(regions.qualify_sites(c)) for c in (frame, stored))
        assert exchanges(kept) < exchanges(plain)
        for options in ({"max_len": None, "min_cpg": 2}, {"max_len": 150, "min_cpg": 2}):
            got, expected = (regions.combine_regions(c, **options) for c in (stored, frame))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
            assert got.count() > 0
    finally:
        spark.sql(f"drop table if exists {name}")
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
