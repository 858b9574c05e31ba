"""WARC derivatives: linked metadata and plain-text records of responses.

Every response gives two records.  The ``conversion`` record holds the page's text; the
``metadata`` record holds the source's headers and digests, one ``name: value`` a line.
Both refer to the response by its record id and keep its target and date; the response's
digest is kept in the metadata and checked sums of the new blocks are in the headers.  All
of it is column expressions, one output row per record, without a shuffle; tags and
character references alone are read by Python.  Responses come from WARC files
(``read_responses``), with the headers and digests that are there, or from a table of pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a page that are no text, with what is in them.
HIDDEN = ((r"(?is)<(?:script|style|noscript|template)\b[^>]*>.*?</(?:script|style|noscript|template)\s*>", " "), (r"(?s)<!--.*?-->", " "))
#: Tags that end a line.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer h1 h2 h3 h4 h5 h6 head header hr html body li main nav ol p pre section table td th title tr ul".split())
#: A tag: its name, and attributes, whose quoted values may hold what would end it.
TAG = re.compile(r"""<(?:/?([A-Za-z][^\s/>]*+)(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+>|[!?/][^>]*+>)""")
#: What is done once references are characters: runs of space become one, empty lines go.
SPACE = (
    (r"[ \t\r]+", " "),
    (r" ?\n[\n ]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)


#: What may be a character reference: decimal, hexadecimal, or named.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)")


@lru_cache(1 << 14)
def _character(reference: str) -> str:
    # zeros first and numbers beyond all characters, of any length, are told by few digits
    short = re.sub(r"^(&#[xX]?)0+(?=[0-9a-fA-F])", r"\1", reference)
    return "\ufffd" if len(short) > 40 else entities.unescape(short).replace("\xa0", " ")


def unescaped(text: str) -> str:
    """``text`` with its character references as characters, in one pass, as HTML 5 reads
    them: all names, also those that may lack the semicolon, and all numbers.  What is no
    reference stays; a reference to the no-break space is a space."""
    return REFERENCE.sub(lambda m: _character(m[0]), text) if "&" in text else text


def untagged(html: str) -> str:
    """``html`` with a newline for each tag of a block and nothing for any other; a ``<``
    that begins no tag is text.  A quote that is not closed is no quote."""
    told, end, rest = html.rpartition(">")  # what follows the last end of a tag has none
    return TAG.sub(lambda m: "\n" if m[1] and m[1].lower() in BLOCKS else "", told + end) + rest


def _plain(texts: pa.Array) -> pa.Array:
    return pa.array((unescaped(untagged(t.as_py())) for t in texts), texts.type)


def page_text(html: Column) -> Column:
    """The text of a page: one line for each block, no empty ones.  Null is empty."""
    replaced = lambda c, s: F.regexp_replace(c, *s)
    plain = F.arrow_udf(_plain, T.StringType())(reduce(replaced, HIDDEN, F.coalesce(html, F.lit(""))))
    return reduce(replaced, SPACE, plain)


def record_id(*parts: Column) -> Column:
    """A urn that depends on the parts alone, so reruns make the same records."""
    h = F.md5(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, date: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response rows of a table of pages: key, record_id, target_uri, date, http_headers,
    body, payload_digest.  Null urls and pages are empty."""
    body = F.coalesce(F.col(html), F.lit(""))
    target = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]+", " ")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return pages.select(F.col(key).alias("key"), record_id(F.lit("response"), F.col(key), target, body).alias("record_id"), target.alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), body.alias("body"), digest(body).alias("payload_digest"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each row of ``source`` (as ``responses`` gives them): key,
    warc_type, record_id, refers_to, target_uri, content_length, block_digest, block and
    record (its whole WARC text).

    Repeated rows give the same records again; an empty page gives an empty conversion;
    an empty table gives none; other columns are not handed on.
    """
    text = page_text(F.col("body"))
    fields = F.concat(
        F.lit("source-record-id: "), F.col("record_id"), F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\n"),
        F.regexp_replace("http_headers", "(?m)^(?=.)", "source-header: "), F.lit("\r\n"),
    )
    one = lambda kind, mime, block: F.struct(F.lit(kind).alias("warc_type"), F.lit(mime).alias("mime"), block.alias("block"))
    made = source.select("key", "target_uri", "date", F.col("record_id").alias("refers_to"), F.explode(F.array(one("metadata", "application/warc-fields", fields), one("conversion", "text/plain; charset=utf-8", text))).alias("r"))
    made = made.select("key", "target_uri", "date", "refers_to", "r.*")
    made = made.withColumns({"record_id": record_id(F.col("warc_type"), F.col("refers_to")), "content_length": F.octet_length("block").cast("long"), "block_digest": digest(F.col("block"))})
    names = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Block-Digest": "block_digest", "Content-Type": "mime", "Content-Length": "content_length"}
    head = F.concat(F.lit("WARC/1.1\r\n"), *(F.concat(F.lit(f"{n}: "), F.col(c).cast("string"), F.lit("\r\n")) for n, c in names.items()), F.lit("\r\n"))
    record = F.concat(head, F.col("block"), F.lit("\r\n\r\n"))
    return made.select("key", "warc_type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "block", record.alias("record"))


def read_record(record: str) -> tuple[dict[str, str], str]:
    """The headers and the block of a record's text."""
    head, _, rest = record.partition("\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    block = rest.encode()[: int(headers["Content-Length"])].decode()
    return headers, block


#: Rows of ``read_responses``.
RESPONSES = "key string, record_id string, target_uri string, date string, http_headers string, body string, payload_digest string"


class _Bytes:
    """What is in a file, gzip members one after the other or plain, read as it is asked for."""

    def __init__(self, file: BinaryIO, part: int = 1 << 20):
        self.file, self.part, self.held, self.over = file, part, bytearray(), False
        first = file.read(part)
        self.zip = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
        self._take(first)

    def _take(self, data: bytes) -> None:
        if not data:
            self.over = True
        elif self.zip is None:
            self.held += data
        while self.zip is not None and data:
            self.held += self.zip.decompress(data)
            data = self.zip.unused_data
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
                data = data.lstrip(b"\0")  # padding between members

    def more(self) -> bool:
        if not self.over:
            self._take(self.file.read(self.part))
        return not self.over

    def upto(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def line(self) -> bytes:
        """The next line with its end, empty at the end of all."""
        at = 0
        while (end := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if not self.more():
                end = len(self.held) - 1
                break
        return self.upto(end + 1)


def fields_of(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; folded lines go on, of repeated ones the first counts."""
    found: list[list[str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and found:
            found[-1][1] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            found.append([name.strip().lower(), value.strip()])
    return {k: v for k, v in reversed(found)}


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file: fields and block.  One that lacks its length ends where
    the next one begins; what is no record is passed over."""
    data = _Bytes(file)
    line = data.line()
    while line:
        if not line.startswith(b"WARC/"):
            line = data.line()
            continue
        head = []
        while (line := data.line()).strip():
            head.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        fields = fields_of(head)
        length = fields.get("content-length", "")
        if length.isascii() and length.isdigit():
            yield fields, data.upto(int(length))
            line = data.line()
            continue
        block = bytearray()
        while (line := data.line()) and not line.startswith(b"WARC/"):
            block += line
        yield fields, bytes(block).removesuffix(b"\r\n\r\n")


def _dechunked(body: bytes) -> bytes:
    out, at = bytearray(), 0
    while (end := body.find(b"\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return body  # not in chunks after all
        n = int(size, 16)
        if n == 0:
            break
        out += body[end + 1 : end + 1 + n]
        at = end + 1 + n + (2 if body[end + 1 + n : end + 3 + n] == b"\r\n" else 1)
    return bytes(out)


def response(fields: dict[str, str], block: bytes) -> tuple[str, str, bytes]:
    """The HTTP headers, the text and the payload's bytes of a response record."""
    cut = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: cut.start()], block[cut.end() :]) if cut else (block, b"")
    headers = head.decode("utf-8", "replace")
    said = fields_of(headers.splitlines()[1:])
    payload = _dechunked(body) if "chunked" in said.get("transfer-encoding", "").lower() else body
    plain = payload
    if said.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            plain = zlib.decompressobj(47).decompress(payload)
        except zlib.error:
            pass
    named = re.search(r"charset=[\"']?([\w.:-]+)", said.get("content-type", ""), re.IGNORECASE)
    try:
        text = plain.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, ValueError):
        text = plain.decode("utf-8", "replace")
    return "\r\n".join(headers.splitlines()), text, payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESPONSES.split(", ")]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = FileSystem.from_uri(path)
            rows, size = [], 0
            with system.open_input_stream(name, compression=None) as file:
                for fields, block in records(file):
                    if fields.get("warc-type", "").lower() != "response":
                        continue
                    headers, text, payload = response(fields, block)
                    told = fields.get("warc-payload-digest") or "sha256:" + hashlib.sha256(payload).hexdigest()
                    rows.append((path, fields.get("warc-record-id", ""), fields.get("warc-target-uri", "").strip("<>"), fields.get("warc-date", ""), headers, text, told))
                    size += len(text)
                    if size >= 8 << 20:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of the WARC files of a folder, for ``derivatives``: key (the
    file), record_id, target_uri, date, http_headers, body and payload_digest as they are in
    the record (a digest that it lacks is made).

    Files are plain or of gzip members; a task streams its files and holds one record and
    a few megabytes of rows.  Bodies in chunks or compressed are read as their headers say,
    text by the charset that they name, else as UTF-8, bad bytes replaced.  A record without
    headers or a body has empty ones; other kinds of records are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    # a task for each file, up to the number of shuffle partitions
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_read, RESPONSES)
