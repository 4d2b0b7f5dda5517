import base64
import gzip
import hashlib
import os

import __spark_entry__ as entry_point
from epilane.llm import warc
from epilane.session import Scratch

from . import cases


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def model(pages):
    """(key, size, digest, type, refers) of each (key, html)."""
    largest = {}
    for key, html in pages:
        if key is not None:
            largest[html or ""] = max(largest.get(html or "", key), key)
    out = []
    for key, html in pages:
        payload = (html or "").encode()
        top = largest.get(html or "")
        refers = top if top is not None and (key is None or key < top) else None
        kind = "response" if refers is None else "revisit"
        out.append((key, len(payload), digest(payload), kind, refers))
    return out


def order(rows):
    return sorted(rows, key=str)


FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_whole_table(spark):
    rows = entry_point.queries()["op1_warc"](spark, cases.FOLDER).collect()
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{cases.FOLDER}/pages.parquet").collect()]
    assert order(tuple(r[f] for f in FIELDS) for r in rows) == order(model(pages))


PAGES = [
    (1, "http://a/ b\nc", "same"),
    (2, None, "same"),
    (3, "http://é", "same"),
    (3, "http://é", "same"),
    (4, "u", None),
    (5, "u", ""),
    (None, "u", "same"),
    (None, "u", "only null keys"),
    (6, "u", "other é\r\n\r\nWARC/1.1\r\n" * 2000),
]


def written(spark, scratch, **options):
    frame = spark.createDataFrame(
        [(*p, "x", 5) for p in PAGES], "page_id long, url string, html string, digest string, offset int"
    )
    folder = f"{scratch.path}/archives"
    return scratch.table(warc.write_warc(frame, folder, **options), "index"), folder


def test_awkward_rows(spark):
    with Scratch(spark) as scratch:
        index, folder = written(spark, scratch)
        rows = warc.read_warc(index, folder, range_bytes=500, max_gap=10).collect()
        assert order(tuple(r[f] for f in FIELDS) for r in rows) == order(
            model([(k, h) for k, _, h in PAGES])
        )
        payload = {r["page_id"]: r["payload"] for r in rows}
        assert bytes(payload[6]).decode() == PAGES[-1][2]


def test_selection_and_files(spark):
    with Scratch(spark) as scratch:
        index, folder = written(spark, scratch, min_revisit_bytes=5, max_file_bytes=100)
        some = warc.read_warc(index.filter("page_id in (2, 6)"), folder).collect()
        assert sorted(r["page_id"] for r in some) == [2, 6]
        assert {r["record_type"] for r in some} == {"response"}
        place = folder.removeprefix("file://")
        records = sum(
            gzip.open(f"{place}/{name}").read().count(b"WARC-Record-ID") for name in os.listdir(place)
        )
        assert records == len(PAGES)


def test_empty(spark):
    with Scratch(spark) as scratch:
        none = spark.createDataFrame([], "page_id long, url string, html string")
        index = scratch.table(warc.write_warc(none, f"{scratch.path}/a"), "index")
        assert warc.read_warc(index, f"{scratch.path}/a").count() == 0
