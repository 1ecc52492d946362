"""Operator 3, WARC derivatives: response records to linked metadata and plain-text conversion records.

A record is a row: its named header fields, its block, and what they are derived from. For each
response, ``derive`` gives one ``metadata`` and one ``conversion`` record. Both name the response in
WARC-Refers-To (with its target address and date), the conversion holds the plain text of the page,
the metadata holds the response's HTTP header fields, digests and links. Record ids are name-based
UUIDs of the response's id, so a task that runs again gives the same records.

Responses come from pages (``responses``: the page has no HTTP head or date of its own, so the head says what
is known and the date is a parameter), or from real response files (``read_responses``), whose own record ids,
dates, addresses, digests and HTTP header fields are kept.

No row is moved: responses stay in their partitions. ``write`` gives gzip-membered file bodies
as rows of bytes; ``read_records`` reads such bodies back, one record at a time.

Edge cases: null html is an empty payload, whose conversion is empty; null addresses are left out of
the header; a null id stays null. Repeated rows give repeated records. Very long pages are converted whole. An empty table
gives no records. Extra columns are ignored. A file cut off in a record ends before that record; header fields without a colon are passed over.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
import zlib

from pyspark.sql import DataFrame

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of addresses
RESPONSE_SCHEMA = "page_id long, record_id string, target_uri string, warc_date string, payload_digest string, block_digest string, block binary"
DERIVED_SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_payload_digest string, block_digest string, content_length long, header string, block binary"
)
_SILENT = re.compile(r"<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|aside|title|form|pre|blockquote|dd|dt|dl|main|head|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_LINK = re.compile(r"<(a|img|link|script|iframe)\b[^>]*?\s(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{kind} {name}')}>"


def plain_text(page: str) -> str:
    """All text of a page: a line for each block, without markup, scripts and styles."""
    text = _TAG.sub("", _BREAK.sub("\n", _SILENT.sub(" ", page)))
    lines = (" ".join(line.split()) for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str) -> list[tuple[str, str]]:
    """(element, address) of each link in page order."""
    return [(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").strip()) for m in _LINK.finditer(_SILENT.sub(" ", page))]


def header(fields: list[tuple[str, str | None]]) -> str:
    """Header lines; line breaks in values would begin a new field and become spaces."""
    return VERSION + "\r\n" + "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields if v is not None) + "\r\n"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html): an HTTP head and the page as payload."""
    import pyarrow as pa

    def made(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in batch.slice(low, 500).columns)):
                    body = (html or "").encode("utf-8", "surrogatepass")
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    rows.append((page, urn("response", f"{page} {url} {digest(body)}"), url, date, digest(body), digest(head + body), head + body))
                yield _batch(pa, rows, RESPONSE_SCHEMA)

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(made, RESPONSE_SCHEMA)


def derive(source: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response record."""
    import pyarrow as pa

    def derived(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                rows = []
                for page, record, url, date, payload, block, data in zip(*(c.to_pylist() for c in batch.slice(low, 250).columns)):
                    head, _, body = (data or b"").partition(b"\r\n\r\n")
                    html = body.decode("utf-8", "replace")
                    http = [line for line in head.decode("latin-1").split("\r\n") if line]
                    meta = [f"sourcePayloadDigest: {payload}", f"sourceBlockDigest: {block}"]
                    meta += [f"httpStatus: {http[0]}"] if http else []
                    meta += [f"httpHeader: {line}" for line in http[1:]]
                    meta += [f"outlink: {address} {element}" for element, address in links(html)]
                    for kind, mime, made in (
                        ("metadata", "application/warc-fields", "".join(f"{line}\r\n" for line in meta).encode("utf-8", "surrogatepass")),
                        ("conversion", "text/plain; charset=utf-8", plain_text(html).encode("utf-8", "surrogatepass")),
                    ):
                        own = urn(kind, record)
                        fields = [
                            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", record),
                            ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", digest(made)),
                            ("WARC-Payload-Digest", digest(made) if kind == "conversion" else None),
                            ("Content-Type", mime), ("Content-Length", str(len(made))),
                        ]
                        rows.append((page, kind, own, record, url, date, mime, payload, digest(made), len(made), header(fields), made))
                yield _batch(pa, rows, DERIVED_SCHEMA)

    names = [c.split()[0] for c in RESPONSE_SCHEMA.split(", ")]
    return source.select(*names).mapInArrow(derived, DERIVED_SCHEMA)


def _batch(pa, rows: list[tuple], schema: str):
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def write(records: DataFrame, file_records: int = 1000) -> DataFrame:
    """Gzip-membered file bodies (name, body) of at most ``file_records`` derived records each."""
    import pyarrow as pa

    def bodies(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, file_records):
                out = io.BytesIO()
                for head, block in zip(*(c.to_pylist() for c in batch.slice(low, file_records).columns)):
                    out.write(gzip.compress(head.encode("utf-8", "surrogatepass") + (block or b"") + b"\r\n\r\n", 6, mtime=0))
                yield _batch(pa, [(f"part-{part:05d}-{number:05d}.warc.gz", out.getvalue())], "name string, body binary")
                number += 1

    return records.select("header", "block").mapInArrow(bodies, "name string, body binary")


def _members(body: bytes, size: int = 1 << 20):
    """The bytes of a file body in pieces: gzip members one after the other, or plain bytes."""
    if not body.startswith(b"\x1f\x8b"):
        yield from (body[k : k + size] for k in range(0, len(body), size))
        return
    at = 0
    while at < len(body):
        one = zlib.decompressobj(31)
        step = 1 << 14  # members are small as a rule; what is read beyond one is read again
        while not one.eof and at < len(body):
            piece = body[at : at + step]
            at += len(piece)
            yield one.decompress(piece)
            step = min(2 * step, size)
        if not one.eof:
            return
        at -= len(one.unused_data)


def read_records(body: bytes):
    """(header fields, block) of each whole record of a file body, in order; no more than one record is held unpacked."""
    held, pieces = bytearray(), _members(body)

    def until(test) -> int:
        """Read on until ``test`` finds a place in what is held; -1 at the end of the file."""
        while (at := test()) < 0:
            piece = next(pieces, None)
            if piece is None:
                return -1
            held.extend(piece)
        return at

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        at = until(lambda: held.find(b"\r\n\r\n"))
        if at < 0:
            return
        lines = held[:at].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = {k.strip(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}
        n = int(fields.get("Content-Length", 0))
        stop = at + 4 + n
        if until(lambda: stop if len(held) >= stop else -1) < 0:
            return
        block = bytes(held[at + 4 : stop])
        del held[:stop]
        until(lambda: 0 if len(held) >= 4 else -1)
        if held[:4] == b"\r\n\r\n":
            del held[:4]
        yield fields, block


def read_responses(files: DataFrame) -> DataFrame:
    """Response records of file bodies (name, body), such as Spark's ``binaryFile`` source or ``write`` give; page_id is null.

    Digests that a record names are kept, others computed. Records of other types are passed over.
    """
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for fields, block in read_records(batch.column(0)[k].as_py() or b""):
                    if fields.get("WARC-Type") == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        named = fields.get("WARC-Record-ID") or urn("response", f"{fields.get('WARC-Target-URI')} {digest(block)}")
                        row = (None, named, fields.get("WARC-Target-URI"), fields.get("WARC-Date"), fields.get("WARC-Payload-Digest") or digest(payload), fields.get("WARC-Block-Digest") or digest(block), block)
                        yield _batch(pa, [row], RESPONSE_SCHEMA)

    return files.select("body").mapInArrow(read, RESPONSE_SCHEMA)


def with_header(source: DataFrame) -> DataFrame:
    """Response records with their own header, as ``write`` takes them."""
    import pyarrow as pa

    names = ["record_id", "target_uri", "warc_date", "payload_digest", "block_digest", "block"]

    def made(batches):
        for batch in batches:
            rows = []
            for record, url, date, payload, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                fields = [
                    ("WARC-Type", "response"), ("WARC-Record-ID", record), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", block),
                    ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(data or b""))),
                ]
                rows.append((header(fields), data))
            yield _batch(pa, rows, "header string, block binary")

    return source.select(*names).mapInArrow(made, "header string, block binary")
