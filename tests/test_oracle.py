"""Every registered query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 0


def ranked_model(rows):
    """Greedy duplicate search over single reads, one after the other."""
    owners, dups = {}, {}
    for name in sorted(rows, key=lambda r: (-rows[r][0], r)):
        hit = next((k for k in rows[name][1] if k in owners), None)
        if hit:
            dups[name] = ("aln:" + hit, owners[hit])
        else:
            owners.update({k: name for k in rows[name][1]})
    return owners, dups


def test_ranked_duplicates_match_the_model(spark):
    from epilane.operators import duplicates
    from epilane.plans import tables

    sam = tables.alignments(spark, FOLDER)
    keyed = duplicates.alignment_keys(sam).orderBy("line_no").collect()
    pairs, singles = {}, {}
    for r in keyed:
        book = pairs if r["is_pair"] else singles
        score, keys = book.get(r["qname"], (None, []))
        if r["primary"]:
            score = (score or 0) + r["score"] if r["is_pair"] else r["score"]
        book[r["qname"]] = (score, [*keys, r["key"]])
    ends = {}
    pairs = {
        n: (s, [f"({min(k)}, {max(k)})"]) for n, (s, k) in pairs.items() if not ends.update({n: k})
    }
    _, pair_dups = ranked_model(pairs)
    taken = {}
    for name in sorted(pairs, key=lambda r: (-pairs[r][0], r)):
        if name not in pair_dups:
            for key in ends[name]:
                taken.setdefault(key, name)
    expected = {(n, *v, "paired-end") for n, v in pair_dups.items()}
    owners = dict(taken)
    scored = {n: v for n, v in singles.items() if v[0] is not None}
    for name in sorted(scored, key=lambda r: (-scored[r][0], r)):
        hit = next((k for k in scored[name][1] if k in owners), None)
        if hit:
            expected.add((name, "aln:" + hit, owners[hit], "single-end"))
        else:
            owners.update({k: name for k in scored[name][1]})
    got = {tuple(r) for r in entry_point.queries()["dups_ranked"](spark, FOLDER).collect()}
    assert got == expected


def test_ranked_duplicates_of_reads_with_several_keys(spark):
    from epilane.operators import duplicates
    from epilane.plans import tables

    sam = tables.hits(spark, FOLDER)
    keyed = duplicates.alignment_keys(sam)
    scores = {r["qname"]: r["score"] for r in duplicates.read_scores(sam).collect()}
    reads = {}
    for r in duplicates.pair_reads(keyed).orderBy("line_no").collect():
        low, high = sorted((r["aln0"], r["aln1"]))
        reads.setdefault(r["qname"], (scores[r["qname"]], []))[1].append(f"({low}, {high})")
    _, dups = ranked_model(reads)
    got = entry_point.queries()["dups_many_keys"](spark, FOLDER).collect()
    assert {(r["qname"], r["parent"]) for r in got} == {(n, p) for n, (_, p) in dups.items()}
    assert all(r["aln"].removeprefix("aln:") in reads[r["qname"]][1] for r in got)
    assert any(len(set(keys)) > 1 for _, keys in reads.values()) and dups
