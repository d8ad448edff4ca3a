"""WARC archives: write pages as segmented, chunked records; read them back and reassemble.

Writing.  Records of equal payloads are found by their digest: a row for each repeated digest (the
smallest page_id) is joined back, so a hot payload is one row on one side.  That page becomes a
``response``, the others are ``revisit`` records without a payload.  A response's HTTP block is framed
in chunks and, beyond a bound, cut into ``continuation`` records.  Spark's text writer separates the
records by the blank lines that the format asks for.

Reading.  Spark's text reader splits the archives at the version line; a fragment shorter than its
Content-Length is joined with its successors, so a payload may hold that line itself.  Archives are
gzip files, read by one task each, record by record.  Continuations are grouped by the identifier of
their origin, ordered by segment number and checked against the total length; then the chunked
framing is decoded and the payload is checked against its digest.

Defined results: a null html is an empty payload; a null page_id loses against any other, and pages
without any id never revisit; repeated rows give equal records; long payloads are cut into segments; control
characters of a URL are percent-encoded; columns besides page_id, url and html are not looked at; an empty table
gives no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, staged

VERSION = b"WARC/1.1\r\n"
SEPARATOR = "\r\n\r\n"
#: Bytes of a record's block from which it is cut into segments; bytes of a chunk of the HTTP framing.
SEGMENT_BYTES, CHUNK_BYTES = 8 << 10, 2 << 10

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# -- records ----------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[end + 2 : at])
        at += 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    coded = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
    return unchunked(body) if coded else body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return VERSION + lines.encode() + b"\r\n" + block


def _urn(page_id: object, digest: str, segment: int = 1) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{segment}>"


def target_uri(url: str | None) -> str:
    """A URL for a header line: characters that no header may hold are percent-encoded, all others stay."""
    return "".join(c if c.isprintable() else quote(c) for c in url or "")


def page_records(page_id: object, url: str | None, payload: bytes, first_id: object) -> Iterator[bytes]:
    """The records of one page; ``first_id`` is the page that it revisits, or None."""
    digest = digest_of(payload)
    target = target_uri(url)
    common = [("WARC-Target-URI", target), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first_id is not None:
        named = [("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Refers-To", _urn(first_id, digest))]
        yield _record([*named, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common], _HTTP)
        return
    block = _HTTP + chunked(payload)
    named = [("WARC-Type", "response"), ("WARC-Record-ID", _urn(page_id, digest))]
    if len(block) <= SEGMENT_BYTES:
        yield _record([*named, *common], block)
        return
    yield _record([*named, *common, ("WARC-Segment-Number", 1)], block[:SEGMENT_BYTES])
    cuts = range(SEGMENT_BYTES, len(block), SEGMENT_BYTES)
    for number, cut in enumerate(cuts, 2):
        last = [("WARC-Segment-Total-Length", len(block))] if cut == cuts[-1] else []
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(page_id, digest, number)), ("WARC-Segment-Origin-ID", _urn(page_id, digest)), ("WARC-Segment-Number", number), *last, *common[:2]],
            block[cut : cut + SEGMENT_BYTES],
        )


# -- writing ----------------------------------------------------------------------------------


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes the WARC records of (page_id, url, html) as gzip archives into the folder ``path``."""
    payloads = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = payloads.select("page_id", "digest").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    repeated = staged(repeated.where("n > 1 and first_id is not null").select("digest", "first_id"), "repeated")
    marked = payloads.join(broadcast_if_small(repeated, 64), "digest", "left")
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64).to_pylist()
                records = [x for r in rows for x in page_records(r["page_id"], r["url"], r["payload"], r["revisits"])]
                yield pa.record_batch([pa.array(records, pa.binary())], names=["record"])

    records = marked.select("page_id", "url", "payload", revisits.alias("revisits")).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


# -- reading ----------------------------------------------------------------------------------

_PARSED = "record_id string, record_type string, digest string, refers_to string, origin_id string, segment int, total_length long, block binary"


def _whole_records(fragments: Iterator[bytes]) -> Iterator[bytes]:
    """Records of the length that they announce, from fragments that may hold a part of one or several.

    A reader may pass over a version line that follows a line break of the block itself; so what stands
    behind a record's length is looked at for the next one.
    """
    mark, held = SEPARATOR.encode() + VERSION, None
    for fragment in fragments:
        held = fragment.removeprefix(VERSION) if held is None else held + mark + fragment
        while held is not None:
            head, gap, _ = held.partition(b"\r\n\r\n")
            if not gap:
                break
            length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            wanted = len(head) + 4 + length
            if len(held) < wanted:
                break
            yield held[:wanted]
            held = held[wanted + len(mark) :] if held.startswith(mark, wanted) else None
    if held is not None:
        raise ValueError("an archive ends within a record")


def parse_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record in the gzip archives of a folder."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for value in batch.column("value"):
                yield value.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for record in _whole_records(fragments(batches)):
            head, _, block = record.partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n"))}
            rows.append(
                (
                    fields["warc-record-id"], fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("warc-refers-to"),
                    fields.get("warc-segment-origin-id", fields["warc-record-id"]), int(fields.get("warc-segment-number", 0)),
                    int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, block,
                )
            )
            size += len(record)
            if size > 8 << 20:
                yield parsed(rows)
                rows, size = [], 0
        yield parsed(rows)

    kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in _PARSED.split(", ")]

    def parsed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    lines = spark.read.option("lineSep", SEPARATOR + VERSION.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, _PARSED)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, digest, refers_to, payload): segments put together, framing decoded and checked."""
    records = parse_archives(spark, path)
    kept = ["record_id", "record_type", "digest", "refers_to"]
    whole = records.where("segment = 0").select(*kept, "block")
    # Equal records of repeated rows have equal segments: one of each is enough, and counts how often.
    segments = records.where("segment > 0").groupBy("origin_id", "segment").agg(
        F.count("*").alias("times"), F.max("total_length").alias("total_length"), F.max("digest").alias("digest"), F.max("block").alias("block")
    )
    joined = segments.groupBy("origin_id").agg(
        F.min("times").alias("times"), F.max("total_length").alias("total_length"), F.max("digest").alias("digest"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )  # the segments of one record: at most a payload

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                out = []
                for r in batch.slice(start, 16).to_pylist():
                    block = b"".join(p["block"] for p in r["parts"])
                    if [p["segment"] for p in r["parts"]] != list(range(1, len(r["parts"]) + 1)) or len(block) != r["total_length"]:
                        raise ValueError(f"segments of {r['origin_id']} are missing")
                    out += [(r["origin_id"], "response", r["digest"], None, block)] * r["times"]
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 4 + [pa.binary()], strict=True)], names=[*kept, "block"])

    schema = "record_id string, record_type string, digest string, refers_to string"
    blocks = whole.unionByName(joined.mapInArrow(together, schema + ", block binary"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                payloads = []
                for kind, digest, block in zip(*(part.column(c).to_pylist() for c in ("record_type", "digest", "block")), strict=True):
                    payloads.append(payload_of(block) if kind == "response" else None)
                    if kind == "response" and digest_of(payloads[-1]) != digest:
                        raise ValueError("a payload doesn't have its digest")
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array(payloads, pa.binary())], names=[*kept, "payload"])

    return blocks.mapInArrow(decoded, schema + ", payload binary")


def page_id_of(urn):
    """The page_id in a record identifier that ``write_archives`` has given."""
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]*):", 1)


def page_summaries(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take the size of what they refer to."""
    small = staged(records.select("record_id", "record_type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes")), "summaries")
    responses = small.where("record_type = 'response'")
    sizes = responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = small.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "refers_to", "left")
    number = lambda c: F.nullif(page_id_of(F.col(c)), F.lit("")).cast("long")
    return responses.unionByName(revisits).select(
        number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        number("refers_to").alias("refers_to"),
    )
