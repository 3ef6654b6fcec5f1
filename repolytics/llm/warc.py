"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Writing: payload digests decide which record answers for equal payloads; each task
writes one archive under a name of its own and the manifest lists those that count.

Reading: archives are cut into byte ranges.  A task scans its range for the gzip magic,
decodes the headers of each candidate member to tell records from chance matches, and
owns the records that start inside its range, reading past the end for the last one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from repolytics.llm.common import checkpointed, heavy_join, new_folder
from repolytics.llm.tokenfiles import make_folder, open_sink, open_source

LEAST_REVISIT = 100
MAGIC = b"\x1f\x8b\x08"
#: WARC/1.1 names (fixed values).
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "2024-01-01T00:00:00Z"
KINDS = ("response", "revisit")
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
_RECORD_ID = re.compile(r"<urn:page:(-?[0-9]+):[0-9a-f]*>")


def _line(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def record_id(page: int | None, digest: str) -> str:
    """The WARC-Record-ID of a page's record: its page_id and the start of its payload's digest."""
    return f"<urn:page:{page}:{digest[:16]}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(record: str | None) -> int | None:
    """The page_id that a record id of this writer names; None of any other."""
    found = _RECORD_ID.fullmatch((record or "").strip())
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, response or revisit, as a gzip member.

    A revisit keeps the HTTP header, whose Content-Length is the size of the payload left out.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def payload_of(html: str | None) -> bytes:
    return (html or "").encode("utf-8", "surrogatepass")


def _write(folder: str):
    def run(batches):
        sink, target, n, size = None, None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for page, url, html, digest, first in zip(*(part.column(i).to_pylist() for i in range(5))):
                    if sink is None:
                        target = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                        sink = open_sink(target)
                    member = record(page, url, payload_of(html), digest, first)
                    sink.write(member)
                    n, size = n + 1, size + len(member)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for every page; gives the manifest: path, records, bytes.

    Of equal payloads of at least least_revisit bytes the smallest page_id is the
    response and the others revisit it; each row is judged by its own payload, so rows
    that repeat a page_id with other payloads are responses or revisits of their own, and
    rows that repeat the smallest page_id with its payload are responses each time.  Null
    html is an empty payload, a null url an empty one; rows without a page_id are
    responses with a record id of their own and answer for no other page; an empty table
    writes nothing; further columns of pages are not looked at.

    A payload that very many pages share is one row of a bounded broadcast (heavy_join),
    so no task gets all of its pages.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    make_folder(folder)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    large = own.filter((F.octet_length(F.coalesce("html", F.lit(""))) >= least_revisit) & F.col("page_id").isNotNull())
    digests = large.select("page_id", F.unhex("digest").alias("digest"))
    first = checkpointed(digests.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    later = heavy_join(digests, first, "digest", "n", "first_page").filter("page_id <> first_page")
    later = later.select(F.col("page_id").alias("later_page"), F.lower(F.hex("digest")).alias("later_digest"), "first_page").distinct()
    linked = own.join(later, (F.col("page_id") == F.col("later_page")) & (F.col("digest") == F.col("later_digest")), "left").select("page_id", "url", "html", "digest", "first_page")
    linked.mapInArrow(_write(folder), "path string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("path string, records long, bytes long").parquet(f"{folder}/manifest")


class _Window:
    """Bytes of a file from an offset on, read ahead in blocks."""

    def __init__(self, source, at: int, block: int = 1 << 20):
        self.source, self.base, self.block, self.data, self.size = source, at, block, b"", source.size()

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.source.seek(at)
        got = self.source.read(min(self.block, self.size - at))
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        self.data, self.base = self.data[to - self.base :], to


def _decoded(value: bytes) -> str:
    """A header's text: UTF-8, or Latin-1 where it is none."""
    try:
        return value.decode("utf-8")
    except UnicodeDecodeError:
        return value.decode("latin-1")


def _headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """The header fields of a record and where its block starts; None if it is none."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None
    fields = {k.decode("latin-1").strip().lower(): _decoded(v).strip() for k, v in _HEADER.findall(data[:end])}
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdecimal() else None


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a file offset and the offset after it.

    A candidate is given up as soon as its first bytes inflate to no WARC header.
    """
    opener, out, position, checked = zlib.decompressobj(31), [], at, False
    while True:
        if position - window.base >= len(window.data) and not window.more():
            return None
        piece = window.data[position - window.base : position - window.base + (1 << 16)]
        try:
            out.append(opener.decompress(piece))
        except zlib.error:
            return None
        if not checked and sum(map(len, out)) >= 5:
            checked = True
            if not b"".join(out).startswith(b"WARC/"):
                return None
        if opener.eof:
            return b"".join(out), position + len(piece) - len(opener.unused_data)
        position += len(piece)


def records_in(source, start: int, end: int):
    """(fields, block, offset) of the records of an archive that start in [start, end)."""
    window, at = _Window(source, start), start
    while at < end:
        found = window.data.find(MAGIC, at - window.base)
        if found < 0:
            keep = max(window.base + len(window.data) - len(MAGIC) + 1, at)
            if not window.more():
                return
            at = keep
            window.drop(at)
            continue
        at = window.base + found
        if at >= end:
            return
        member = _member(window, at)
        parsed = _headers(member[0]) if member else None
        if parsed is None:
            at += 1
            continue
        fields, body = parsed
        yield fields, member[0][body : body + int(fields["content-length"])], at
        at = member[1]
        window.drop(at)


_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_record string, path string, offset long, digest_ok boolean, payload binary"


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    """(payload or None, its size, its SHA-256, whether the header's digest is that) of a record.

    A block of HTTP is a header and a payload, any other block all payload.  The size of
    what a revisit leaves out is the Content-Length of the HTTP header it keeps; its digest
    is the header's.
    """
    named, _, digest = fields.get("warc-payload-digest", "").partition(":")
    head, body = b"", block
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "revisit":
        sizes = [v for k, v in _HEADER.findall(head) if k.strip().lower() == b"content-length" and v.strip().isdigit()]
        return None, int(sizes[0]) if sizes else 0, digest if named.lower() == "sha256" else "", True
    found = hashlib.sha256(body).hexdigest()
    return body, len(body), found, named.lower() != "sha256" or found == digest


def _read(payloads: bool, kinds: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            for target, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows, held = [], 0
                for fields, block, offset in records_in(open_source(target), start, end):
                    if (kind := fields["warc-type"].lower()) not in kinds:
                        continue
                    payload, size, digest, sound = _parsed(fields | {"warc-type": kind}, block)
                    own, refers = fields.get("warc-record-id"), fields.get("warc-refers-to")
                    rows.append((page_of(own), fields.get("warc-target-uri"), kind, size, digest, page_of(refers), own, refers, target, offset, sound, payload if payloads else None))
                    held += len(payload or b"") if payloads else 0
                    if len(rows) == 256 or held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in _RECORDS.split(", ")])


def read_archives(manifest: DataFrame, split_bytes: int = 4 << 20, payloads: bool = False, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The records of these kinds in all archives of a manifest (path, bytes), range by range.

    page_id and refers_to are what the record ids (WARC-Record-ID, WARC-Refers-To) of this
    writer name; records of other writers have null there and their ids in record_id and
    refers_record.  Records of other kinds (warcinfo, request, ...) and gzip members that
    hold no record are passed over; headers that are not UTF-8 are read as Latin-1.
    """
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    total = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(1))).first()[0]
    return ranges.repartition(max(1, min(int(total), 100_000)), "path", "start").mapInArrow(_read(payloads, kinds), _RECORDS)


#: DuckDB SQL for the rows of the query.
ORACLE = """
WITH q AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM q WHERE payload_bytes >= 100 GROUP BY 1),
j AS (SELECT q.*, CASE WHEN payload_bytes >= 100 AND first_page <> page_id THEN first_page END AS refers_to FROM q LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""
