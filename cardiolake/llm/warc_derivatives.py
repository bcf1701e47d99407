"""Derivative builder for WARC: responses become linked metadata and plain-text conversion records.

Every response gives one ``metadata`` record and, if its payload is HTML or plain text, one ``conversion`` record. Both carry
``WARC-Refers-To`` (the response's record id), ``WARC-Refers-To-Target-URI`` and ``WARC-Refers-To-Date``, the target URI and
the date of the response. The metadata block is ``application/warc-fields``: the HTTP status and each source header, the
source's content type, the payload digest, and the id of the conversion record. The conversion block is the visible text
(``html_text``) or the text itself, of the body after its transfer coding (chunked) and content coding (gzip, deflate) are undone. Digests are ``sha1:`` with base 32, over the block (``WARC-Block-Digest``) and over the
source's payload (``source_payload_digest``, in written records ``WARC-Refers-To-Payload-Digest``; an incoming digest is kept, and
marked if it fits neither the payload as stored nor the one without its transfer coding). Record
ids are name-based UUIDs of the source id and the record type, so reruns and retried tasks give the same ids.

``serialize`` gives the records as WARC/1.1 bytes; ``write_warc`` writes gzip members to files in the shared folder and
returns the manifest; ``parse_warc`` reads such bytes back.

Defined cases: null payload or empty payload gives only the metadata record (payload length 0); a null record id is replaced
by a name-based one of the target URI and payload digest; a null target URI is left out of the headers; a null date is written as
``NO_DATE``, since records must have one; unknown content types and codings give only metadata; bodies that break their coding are
taken as far as they can be read; bytes that aren't valid in the declared charset are replaced; very long payloads are converted
whole; repeated rows give repeated records; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, stash
from .html_text import to_text

_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")
# The encodings that web pages may name, under the names of Python's codecs (fixed values).
WEB = frozenset("utf-8 cp866 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 koi8-r koi8-u mac-roman mac-cyrillic cp874 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 gbk gb18030 big5 big5hkscs euc_jp iso2022_jp shift_jis cp932 euc_kr cp949 utf-16-be utf-16-le utf-16".split())
#: Bytes that a body may have without its content coding. A larger one is not converted, and its metadata says so.
MOST_BODY = 64 << 20
#: The date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
_EMPTY_LINE = re.compile(rb"\r?\n\r?\n")
_LINE = re.compile(r"[\r\n]+[ \t]*")
SCHEMA = "source_key string, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, digest_matches boolean, block binary"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(parts).encode()).digest(), version=3)}>"


def http_message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response block; the head ends at its first empty line, whatever its line ends."""
    end = _EMPTY_LINE.search(block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    headers = [(k.strip(), v.strip()) for k, m, v in (x.partition(":") for x in lines[1:]) if m]
    return (lines[0].strip() if lines else ""), headers, payload


def codec(label: str) -> str:
    """The codec of a charset's label, if that is an encoding of the web; else UTF-8."""
    try:
        name = codecs.lookup(label).name
    except (LookupError, ValueError):
        return "utf-8"
    return {"ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "tis-620": "cp874", "gb2312": "gbk"}.get(name, name if name in WEB else "utf-8")


def _decode(payload: bytes, content_type: str) -> str:
    m = _CHARSET.search(content_type) or _CHARSET.search(payload[:1024].decode("latin-1"))
    return payload.decode(codec(m[1]) if m else "utf-8", "replace")


def dechunk(body: bytes) -> bytes:
    """A chunked body's data, up to the last chunk or to where the coding breaks; a body that isn't chunked at all as it is."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        n = int(m[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(out) if out else body


class TooLarge(ValueError):
    pass


def uncompress(body: bytes, coding: str, most: int = MOST_BODY) -> bytes | None:
    """A body without its content coding, as far as it can be read; null if the coding isn't known. Raises ``TooLarge`` as soon as that
    would have more than ``most`` bytes."""
    for name in reversed([x.strip() for x in coding.lower().split(",") if x.strip() not in ("", "identity")]):
        if name not in ("gzip", "x-gzip", "deflate"):
            return None
        # deflate comes with and without the zlib head
        raw = name == "deflate" and not (len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0)
        out, left = [], most
        while body:
            stream = zlib.decompressobj(-15 if raw else 47)
            try:
                out.append(stream.decompress(body, left + 1))
            except zlib.error:
                break
            left -= len(out[-1])
            if left < 0:
                raise TooLarge
            body = stream.unused_data if name != "deflate" else b""
        body = b"".join(out)
    return body


def derive(key: str | None, record_id: str | None, uri: str | None, date: str | None, given: str | None, block: bytes | None) -> Iterator[tuple]:
    """The records of one response, as rows of ``SCHEMA``."""
    status, headers, payload = http_message(block or b"")
    header = {k.lower(): v for k, v in reversed(headers)}
    kind = header.get("content-type", "")
    found = digest(payload)
    source = record_id or _id("response", uri or "", found)
    data = dechunk(payload) if "chunked" in header.get("transfer-encoding", "").lower() else payload
    text, too_large = None, False
    try:
        body = uncompress(data, header.get("content-encoding", "")) if payload else None
    except TooLarge:
        body, too_large = None, True
    if body is not None:
        if "html" in kind.lower():
            text = to_text(_decode(body, kind))
        elif kind.lower().startswith("text/plain"):
            text = _decode(body, kind)
    conversion = _id(source, "conversion") if text is not None else None
    fields = [("http-status-line", status), *((f"http-header-{k.lower()}", v) for k, v in headers), ("source-payload-digest", given or found), ("source-payload-length", str(len(payload)))]
    fits = given in (found, digest(data)) if given else None
    if fits is False:
        fields.append(("source-payload-digest-computed", found))
    if too_large:
        fields.append(("conversion-refused", f"body of more than {MOST_BODY} bytes"))
    if conversion:
        fields.append(("conversion-record-id", conversion))
    body = "".join(f"{k}: {_LINE.sub(' ', v)}\r\n" for k, v in fields).encode()
    yield key, "metadata", _id(source, "metadata"), source, uri, date, "application/warc-fields", len(body), digest(body), given or found, fits, body
    if conversion:
        body = text.encode("utf-8", "replace")
        yield key, "conversion", conversion, source, uri, date, "text/plain; charset=utf-8", len(body), digest(body), given or found, fits, body


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in SCHEMA.split(", ")]
    for batch in batches:
        rows = [x for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in derive(*r)]
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Derivatives of ``responses(source_key, record_id, target_uri, warc_date, payload_digest, block)``; see ``SCHEMA``."""
    cols = [F.col(c).cast("string") for c in ("source_key", "record_id", "target_uri", "warc_date", "payload_digest")]
    return responses.select(*cols, F.col("block").cast("binary")).mapInArrow(_build, SCHEMA)


def responses_of_pages(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """Response records for a table ``pages(page_id, url, html)`` of bodies without their HTTP heads."""
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    name = F.md5(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col("page_id").cast("string").alias("source_key"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        (date if date is not None else F.lit("1970-01-01T00:00:00Z")).alias("warc_date"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.concat(head, F.coalesce("html", F.lit(""))).cast("binary").alias("block"),
    )


def serialize(row: dict) -> bytes:
    """One WARC/1.1 record."""
    heads = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"] or NO_DATE), ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Refers-To-Target-URI", row["target_uri"]), ("WARC-Refers-To-Date", row["warc_date"]), ("WARC-Refers-To-Payload-Digest", row["source_payload_digest"]), ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_LINE.sub(' ', v)}\r\n" for k, v in heads if v is not None).encode() + b"\r\n" + bytes(row["block"]) + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        heads = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        n = int(heads["Content-Length"])
        yield heads, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n + 4


def write_warc(records: DataFrame, file_bytes: int = 256 << 20) -> tuple[str, DataFrame]:
    """Writes records as gzip members; returns the folder and the manifest ``(file, records)`` of committed tasks."""
    spark = records.sparkSession
    folder = new_path(spark, "warc")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        out, name, count = None, "", 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, count = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = target.open_output_stream(f"{base}/{name}", compression=None)
                out.write(gzip.compress(serialize(row), 6))
                count += 1
                if out.tell() >= file_bytes:
                    out.close()
                    out = None
                    yield pa.record_batch([pa.array([name]), pa.array([count])], names=["file", "records"])
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([count])], names=["file", "records"])

    return folder, stash(records.mapInArrow(run, "file string, records long"), "manifest")
