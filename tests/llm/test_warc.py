import base64
import hashlib

import pytest

from tidemark.llm import warc
from tidemark.llm.common import fresh_path, table


def brute(pages):
    firsts = {}
    for i, html in pages:
        payload = (html or "").encode()
        if i is not None:
            firsts[payload] = min(i, firsts.get(payload, i))
    out = []
    for i, html in pages:
        payload = (html or "").encode()
        first = firsts.get(payload)
        revisit = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, pages):
    path = fresh_path(spark, "archives")
    warc.write_archives(pages, path)
    return path, warc.read_archives(spark, path)


def test_round_trip(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    copies = pages.where("page_id < 9").selectExpr("page_id + 1000 as page_id", "url", "html")
    pages = pages.select("page_id", "url", "html").unionByName(copies)
    path, records = round_trip(spark, pages)
    assert sorted(map(tuple, warc.page_summaries(records).collect()), key=str) == brute([(r["page_id"], r["html"]) for r in pages.collect()])
    kinds = {r["record_type"] for r in warc.parse_archives(spark, path).collect()}
    assert {"response", "continuation", "revisit"} <= kinds


def test_edge_cases(spark):
    big = "é" * 60_000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 70_000
    rows = [(3, None), (1, ""), (7, big), (8, big), (None, "a"), (9, "a"), (None, "only"), (11, "\r\n\r\nWARC/1.1\r\n" * 3), (12, "twice"), (12, "twice"), (13, big + "!"), (13, big + "!")]
    pages = spark.createDataFrame([(i, "http://x/\r\nb", h, "z") for i, h in rows], "page_id long, url string, html string, digest string")
    _, records = round_trip(spark, pages)
    assert sorted(map(tuple, warc.page_summaries(records).collect()), key=str) == brute(rows)
    payloads = {bytes(r["payload"]) for r in records.collect() if r["record_type"] == "response"}
    assert payloads == {(h or "").encode() for _, h in rows}
    _, none = round_trip(spark, pages.where("false"))
    assert warc.page_summaries(none).count() == 0


def test_bad_archives(spark, tmp_path):
    block = warc._HTTP + warc.chunked(b"q" * 100_000)
    records = list(warc.page_records(1, "u", b"q" * 100_000, None))
    assert len(records) > 2 and warc.payload_of(block) == b"q" * 100_000
    for name, lost in (("lost", records[:1] + records[2:]), ("cut", records[:-1] + [records[-1][:-5]])):
        import gzip

        (tmp_path / name).mkdir()
        with gzip.open(tmp_path / name / "a.warc.gz", "wb") as out:
            out.write(b"".join(r + b"\r\n\r\n" for r in lost)[: None if name == "lost" else -4])
        with pytest.raises(Exception, match="missing|ends within"):
            warc.read_archives(spark, str(tmp_path / name)).collect()


def test_fragments_join_and_part():
    records = [x for i in range(3) for x in warc.page_records(i, "u", b"line\r\n" * 4000 + b"\r\n\r\nWARC/1.1\r\n", None)]
    whole = [r.removeprefix(warc.VERSION) for r in records]
    archive = b"".join(r + b"\r\n\r\n" for r in records)
    mark = b"\r\n\r\n" + warc.VERSION
    assert list(warc._whole_records(iter(archive.split(mark)))) == whole
    assert list(warc._whole_records(iter([archive]))) == whole
    missed = archive.split(mark)
    assert list(warc._whole_records(iter([mark.join(missed[:2]), *missed[2:]]))) == whole


def test_urls_are_encoded_not_cut():
    record = next(warc.page_records(1, "http://x/\r\nWARC-Type: a\x85é", b"", None))
    assert b"WARC-Target-URI: http://x/%0D%0AWARC-Type: a%C2%85" + "é".encode() + b"\r\n" in record
    assert warc.target_uri(None) == "" and warc.target_uri("http://a/b c?d=%20") == "http://a/b c?d=%20"
