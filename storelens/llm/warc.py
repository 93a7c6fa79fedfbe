"""WARC derivatives: response records become a metadata and a plain-text conversion record each.

Both records name the response they come from (WARC-Refers-To with its identifier, target URI and date),
keep its HTTP headers and payload digest, and carry digests of their own blocks. Identifiers are
name-based, so a rerun writes the same records; a page's name holds its payload's digest. Digests are ``sha1:`` with base 32.
Payloads are read in the charset of their HTTP headers, UTF-8 if these name none that is known.

Defined results: a null payload is an empty one; a null target URI or date leaves its header out; null HTTP
headers are none; repeated responses give repeated records; an empty table gives no rows; bytes that the charset
doesn't have are read as replacement characters. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import parse, walk

CRLF = "\r\n"
RECORD = ("record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, "
          "source_headers string, source_digest string, block binary, block_digest string, content_length long, n_links long")
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


_CHARSET = re.compile(r"^content-type:[^\r\n]*?;\s*charset\s*=\s*[\"']?([^\s;\"']+)", re.IGNORECASE | re.MULTILINE)


def charset(headers: str) -> str:
    """The charset that HTTP headers name, if it is one of text that is known."""
    found = _CHARSET.search(headers)
    try:
        name = codecs.lookup(found[1]).name if found else "utf-8"
        b"x".decode(name)
    except (LookupError, ValueError):  # unknown, or none of text
        return "utf-8"
    return name


def _record(kind: str, source: str, uri, date, content_type: str, headers: str, source_digest: str, block: bytes, n_links: int):
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"
    return own, kind, source, uri, date, content_type, headers, source_digest, block, digest(block), len(block), n_links


def derivatives(record_id: str, uri: str | None, date: str | None, headers: str | None, payload: bytes | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    payload, headers = payload or b"", headers or ""
    page = parse(payload.decode(charset(headers), "replace"))
    blocks = [t for _, t in walk(page.root)]
    fields = [("title", " ".join("".join(page.title).split())), ("language", page.lang or ""), ("blocks", str(len(blocks))),
              *(("outlink", " ".join(x.split())) for x in page.links)]
    meta = "".join(f"{k}: {v}{CRLF}" for k, v in fields if v).encode("utf-8", "replace")
    text = "\n\n".join(blocks).encode("utf-8", "replace")
    origin = (headers, digest(payload))
    return [_record("metadata", record_id, uri, date, "application/warc-fields", *origin, meta, len(page.links)),
            _record("conversion", record_id, uri, date, "text/plain; charset=utf-8", *origin, text, len(page.links))]


def _derive(batches):
    for b in batches:
        rows = [r for x in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in derivatives(*x)]
        kinds = [pa.string()] * 8 + [pa.binary(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=NAMES)


def derive(responses: DataFrame) -> DataFrame:
    """Derivative records of ``responses (record_id, target_uri, date, http_headers, payload)``."""
    return responses.select("record_id", "target_uri", "date", "http_headers", "payload").mapInArrow(_derive, RECORD)


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``pages (page_id, url, html)`` as response records."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("page_id", "url")]
    md5 = F.md5(F.concat_ws(" ", *known, F.sha1(payload)))
    part = lambda a, n: F.substring(md5, a, n)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.length(payload).cast("string"), F.lit(CRLF))
    return pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), payload.alias("payload"))


def serialized(r) -> bytes:
    """One derivative record as it stands in a WARC file."""
    head = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["target_uri"]),
            ("WARC-Refers-To", r["refers_to"]), ("WARC-Refers-To-Target-URI", r["target_uri"]), ("WARC-Refers-To-Date", r["date"]),
            ("WARC-Refers-To-Payload-Digest", r["source_digest"]),
            *(("WARC-Source-Header", line) for line in (r["source_headers"] or "").split(CRLF)),
            ("WARC-Block-Digest", r["block_digest"]), ("Content-Type", r["content_type"]), ("Content-Length", str(r["content_length"]))]
    lines = [f"{k}: {' '.join(v.split())}" for k, v in head if v]
    return CRLF.join(["WARC/1.1", *lines, "", ""]).encode() + bytes(r["block"]) + b"\r\n\r\n"


def _serialize(batches):
    for b in batches:
        yield pa.record_batch([b.column("record_id"), pa.array([serialized(r) for r in b.to_pylist()], pa.binary())], names=["record_id", "record"])


def to_records(derived: DataFrame) -> DataFrame:
    """``(record_id, record)``: the bytes of each record, to be written one after the other."""
    return derived.mapInArrow(_serialize, "record_id string, record binary")


def parsed(data: bytes):
    """(headers, block) of each record in the bytes of a WARC file; headers as a list of pairs."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        pairs = [tuple(x.split(": ", 1)) for x in data[at:stop].decode("utf-8").split(CRLF)[1:]]
        size = int(dict(pairs)["Content-Length"])
        yield pairs, data[stop + 4:stop + 4 + size]
        at = stop + 4 + size + 4


def derivative_report(pages: DataFrame) -> DataFrame:
    """The derivative records of all pages, whole: what ``to_records`` writes."""
    return derive(responses_of_pages(pages))
