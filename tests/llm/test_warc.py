import base64
import gzip
import hashlib

import pytest

from placelens.llm.queries import QUERIES
from placelens.llm.warc import RECORD, assemble, parse_archive, read_warc, write_warc
from tests.llm.rows import SF, table


def expected(rows):
    first = {}
    for page, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", page)
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        lead = first[html or ""]
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if lead == page else "revisit", None if lead == page else lead))
    return sorted(out)


def test_query_round_trip(spark):
    rows = [(r["page_id"], r["html"]) for r in table(spark, "pages").collect()]
    got = QUERIES["op1_warc_transactions"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(tuple(r) for r in got) == expected(rows)


ODD = [
    (5, "http://a/\r\nX: y z", "<p>é日本</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "x"),
    (3, None, None, "x"),
    (4, "http://b/", "", "x"),
    (9, "http://b/", "same", "x"),
    (8, None, "same", "x"),
    (7, "http://c/", "x" * 300_000, "x"),
    (7, "http://c/", "x" * 300_000, "x"),
    (None, "http://n/", "same", "x"),
]


def test_odd_captures_survive(spark, tmp_path):
    pages = spark.createDataFrame(ODD, "page_id bigint, url string, html string, payload string")
    write_warc(pages, str(tmp_path / "w"))
    rows = assemble(read_warc(spark, str(tmp_path / "w"))).collect()
    assert len(rows) == len(ODD)
    payloads = sorted(bytes(r["payload"]) for r in rows if r["type"] == "response")
    assert payloads == sorted((h or "").encode() for h in {h or "" for _, _, h, _ in ODD})
    by_id = {r["capture_id"]: r for r in rows}
    key = lambda r: dict((e["key"], e["value"]) for e in r["metadata"][0]["fields"]).get("page_id")
    for r in rows:
        assert len(r["requests"]) == len(r["metadata"]) == 1
        if r["type"] == "revisit":
            assert by_id[r["refers_to"]]["payload_digest"] == r["payload_digest"]
    assert {key(by_id[r["refers_to"]]) for r in rows if r["type"] == "revisit"} == {"3", "8", "7"}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    write_warc(pages, str(tmp_path / "w"))
    assert assemble(read_warc(spark, str(tmp_path / "w"))).count() == 0


def test_links_in_either_direction_and_through_a_record(spark):
    record = lambda i, kind, *to: (i, kind, None, list(to), None, None, None, None, None, None)
    records = [record("r1", "response", "q1"), record("q1", "request"), record("m1", "metadata", "q1"), record("m2", "metadata", "nowhere"), record("r2", "response"), record("r2", "response")]
    got = {r["capture_id"]: r for r in assemble(spark.createDataFrame(records, RECORD)).collect()}
    assert set(got) == {"r1", "r2", "m2"}
    assert [x["record_id"] for x in got["r1"]["requests"]] == ["q1"]
    assert [x["record_id"] for x in got["r1"]["metadata"]] == ["m1"]
    assert got["m2"]["type"] is None and got["r2"]["requests"] is None


def test_parser_takes_members_and_refuses_damage():
    one = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [b for _, b in parse_archive(gzip.compress(one) + gzip.compress(one))] == [b"hi", b"hi"]
    with pytest.raises(ValueError):
        list(parse_archive(one[:-8]))
    with pytest.raises(ValueError):
        list(parse_archive(b"junk" + one))
