"""Archives: round trip, conversion, and defined cases."""

from __future__ import annotations

import base64
import hashlib

from tickloom.llm import arc_warc
from tickloom.llm.queries import op10_warc


def expected(rows):
    first, out = {}, []
    for i, (k, html) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        first.setdefault(html or "", (i, k))
        data = (html or "").encode()
        again = first[html or ""][0] != i
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""][1] if again else None))
    return sorted(out, key=repr)


def test_query_matches_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op10_warc(spark, sf).collect()), key=repr) == expected(pages)


def test_copies_nulls_and_line_breaks(spark, monkeypatch):
    big = "é\r\n\r\nWARC/1.1\r\n\r\n" * 400_000
    rows = [(5, "http://a b/\n", "same"), (2, None, "same"), (3, "http://c/", None), (4, "http://d/", ""), (4, "http://d/", ""), (None, "u", "same"),
            (9, "u", big), (1, "u", "filedesc://x 1 2 3\n1 0 x\n\n"), (-7, "u", "\n"), (8, "u", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, archive string").repartition(3)
    got = arc_warc.archive_pages(pages)
    cols = ["key", "payload_bytes", "payload_digest", "warc_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(cols).collect()), key=repr) == expected([(k, h) for k, _, h in rows])
    assert {r.url for r in got.collect() if r.key == 5} == {"http://a%20b/%0A"}
    assert arc_warc.archive_pages(pages.limit(0)).count() == 0


def test_both_header_versions_and_dates():
    v1 = arc_warc.version_block("a.arc", 1) + arc_warc.arc_record(1, "a.arc", 9, 1, "http://x/", "one")
    v2 = arc_warc.version_block("b.arc", 2) + arc_warc.arc_record(2, "b.arc", 9, 2, "http://y/ z", "two")
    for data, body in ((v1, b"one"), (v2, b"two")):
        head, record = arc_warc.parse_arc(data)
        assert head["url"].startswith(b"filedesc://") and arc_warc.split_http(record["block"])[1] == body and not record["truncated"]
        fields, block = next(arc_warc.parse_warc(arc_warc.warc_record("a", record)))
        assert fields[b"warc-date"] == b"2000-01-01T00:00:00Z" and fields[b"warc-type"] == b"response" and block.endswith(body)
        assert int(fields[b"content-length"]) == len(block)
    assert arc_warc.warc_date("19991231") == "1999-12-31T00:00:00Z" and arc_warc.warc_date("x") == "1970-01-01T00:00:00Z"


def test_damaged_archives():
    good = arc_warc.arc_record(1, "a", 0, 1, "http://x/", "one")
    assert [r["url"] for r in arc_warc.parse_arc(b"rubbish line\n\n" + good)] == [b"http://x/"]
    cut = list(arc_warc.parse_arc(good[:-3]))
    assert cut[0]["truncated"] and b"WARC-Truncated: length" in arc_warc.warc_record("a", cut[0])
    dns = b"dns:x 0.0.0.0 19990101 text/dns 3\nabc\n"
    assert b"WARC-Type: resource" in arc_warc.warc_record("a", next(arc_warc.parse_arc(dns)))


def test_short_payloads_may_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    arc, warc = arc_warc.fresh_path(spark, "arc"), arc_warc.fresh_path(spark, "warc")
    arc_warc.write_arc(pages, arc, "page_id", "url", "html")
    arc_warc.convert(spark, arc, warc, least_bytes=3)
    read = {r.key: (r.warc_type, r.refers_to, r.payload) for r in arc_warc.read_warc(spark, warc).collect()}
    assert read == {1: ("response", None, b"ab"), 2: ("response", None, b"ab"), 3: ("response", None, b"abcd"), 4: ("revisit", 3, None)}


def test_a_rerun_gives_the_same_archives(spark):
    """Names of archives tell their tasks apart, and record ids don't hang on the names of Spark's files."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"text {i % 7}") for i in range(60)], "page_id long, url string, html string").repartition(3, "page_id")
    runs = []
    for _ in range(2):
        arc, warc = arc_warc.fresh_path(spark, "arc"), arc_warc.fresh_path(spark, "warc")
        arc_warc.write_arc(pages, arc, "page_id", "url", "html")
        arc_warc.convert(spark, arc, warc)
        names = {name for r in arc_warc._files(spark, arc).collect() for name, _ in arc_warc.named(r.archive, arc_warc.unzipped(bytes(r.content)))}
        runs.append((names, sorted((r.key, r.record_id) for r in arc_warc.read_warc(spark, warc).collect())))
    assert runs[0] == runs[1] and len(runs[0][0]) == 3 and len({i for _, i in runs[0][1]}) == 60
