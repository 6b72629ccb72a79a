"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Each response record yields two records.  ``metadata`` describes it (title, language, the source's
HTTP header lines, payload digest and length, links); ``conversion`` holds its plain text.  Both refer
to the response by its record id, target URI and date, name each other as concurrent, and carry
digests of their own blocks.  Record ids follow from the response's id, so that a task that runs again
makes the same records.

Defined results: a null payload is empty, null headers are none, a null target URI leaves its lines
out; rows that repeat a record id repeat those of its records; a null record id is refused by no line but ``WARC-Refers-To``, which is left out; repeated rows
are each converted; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.llm.common import parts
from casegate.llm.html import ATTRIBUTES

VERSION = "WARC/1.1"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space
# A head ends where something follows that cannot stand in it: its end tag is optional.
_HEAD = (
    rf"head(?=[\s/>]){ATTRIBUTES}(?:>|\Z)(?:\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    rf"|<(title|script|style|template|noscript|noframes)(?=[\s/>]){ATTRIBUTES}>(?:.*?</\1\s*>|.*?(?=</head\s*>))"
    rf"|<(?:html|head|base|basefont|bgsound|link|meta)(?=[\s/>]){ATTRIBUTES}(?:>|\Z)"
    r"|</(?!(?:body|html|br)[\s/>])[a-z][^>]*>)*"
)
_LEFT_OUT = re.compile(
    rf"<(?:!--.*?(?:-->|\Z)|{_HEAD}|(script|style|template|noscript)\b.*?(?:</\2\s*>|\Z))", re.S | re.I
)
_BREAK = re.compile(
    r"\s*</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|t[drh]|title|ul)"
    rf"(?=[\s/>]){ATTRIBUTES}>\s*",
    re.I,
)
_TAG = re.compile(rf"</?[a-zA-Z][^\s/>]*{ATTRIBUTES}(?:>|\Z)|<[/!?][^>]*(?:>|\Z)")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\n ]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_ANCHOR = re.compile(rf"<a(?=[\s/])({ATTRIBUTES})(?:>|\Z)", re.I)
# An attribute name begins after white space or a slash, so data-href and the insides of values do not count.
_ATTRIBUTE = re.compile(r"""[^\s/>=][^\s/>=]*(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*))?)?""")
_COMMENTS = re.compile(r"<!--.*?(?:--!?>|\Z)|<(script|style|template|noscript|textarea|title)(?=[\s/>]).*?(?:</\1\s*>|\Z)", re.S | re.I)


def digest(block: bytes) -> str:
    """Labelled base-32 SHA-1, as WARC records carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def plain_text(source: str) -> str:
    """One line a block of the page, without mark-up."""
    text = _TAG.sub("", _BREAK.sub("\n", _LEFT_OUT.sub("\n", source)))
    if "&" in text:
        text = html.unescape(text)
    return _LINES.sub("\n", _BLANK.sub(" ", text)).strip()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, kind + ' ' + source)}>"


def one_line(text: str) -> str:
    return " ".join(text.split())


def links(payload: str) -> Iterator[str]:
    """The ``href`` of every anchor that is not in a comment or a script."""
    for anchor in _ANCHOR.finditer(_COMMENTS.sub(" ", payload)):
        for found in _ATTRIBUTE.finditer(anchor[1]):
            name, _, _ = found[0].partition("=")
            if name.strip().lower() == "href" and "=" in found[0]:
                yield next((value for value in found.groups() if value is not None), "")
                break


def metadata_block(uri: str | None, headers: str | None, payload: str, source_digest: str) -> bytes:
    """``application/warc-fields`` about the response."""
    lines = []
    if title := _TITLE.search(payload):
        lines.append(f"title: {one_line(html.unescape(title[1]))}")
    if language := _LANGUAGE.search(payload):
        lines.append(f"language: {language[1]}")
    lines += [f"source-payload-digest: {source_digest}", f"source-payload-length: {len(payload.encode())}"]
    lines += [f"source-header: {line.strip()}" for line in (headers or "").splitlines() if line.strip()]
    for link in links(payload):
        target = one_line(html.unescape(link))
        try:
            target = urljoin(uri or "", target)
        except ValueError:  # not a URL: as it stands
            pass
        lines.append(f"outlink: {target} L a/@href")
    return "".join(line + "\r\n" for line in lines).encode()


def record(kind: str, own_id: str, date: str, fields: list[tuple[str, str | None]], content: str, block: bytes) -> str:
    """The whole record, with the two line ends that close it."""
    header = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), *fields]
    header += [("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {one_line(v)}\r\n" for k, v in header if v is not None)
    return f"{VERSION}\r\n{lines}\r\n{block.decode()}\r\n\r\n"


SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, source_digest string, "
    "block_digest string, content_length long, record string"
)


def derivatives(responses: DataFrame, key_col: str | None = None) -> DataFrame:
    """Two rows per response (``record_id, target_uri, date, headers, payload``), with its key."""
    key = F.col(key_col) if key_col else F.lit(None).cast("string")
    read = responses.select(key.alias("key"), *(F.col(c).cast("string").alias(c) for c in ("record_id", "target_uri", "date", "headers", "payload")))
    kind = read.schema["key"].dataType.simpleString()
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "payload"):
            rows = []
            columns = [batch[c].to_pylist() for c in ("record_id", "target_uri", "date", "headers", "payload")]
            for source, uri, date, headers, payload in zip(*columns, strict=True):
                payload, seed = payload or "", source or f"{uri} {date}"
                source_digest = digest(payload.encode())
                ids = {k: record_id(k, seed) for k in ("metadata", "conversion")}
                blocks = {
                    "metadata": ("application/warc-fields", metadata_block(uri, headers, payload, source_digest)),
                    "conversion": ("text/plain; charset=utf-8", plain_text(payload).encode()),
                }
                for own, other in (("metadata", "conversion"), ("conversion", "metadata")):
                    content, block = blocks[own]
                    fields = [
                        ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
                        ("WARC-Concurrent-To", ids[other]), ("WARC-Target-URI", uri), ("WARC-Source-Payload-Digest", source_digest),
                    ]
                    made = record(own, ids[own], date or "", fields, content, block)
                    rows.append((own, ids[own], source, uri, source_digest, digest(block), len(block), made))
            made = list(zip(*rows, strict=True)) or [[]] * 8
            twice = batch["key"].take(pa.array([i for i in range(batch.num_rows) for _ in range(2)], pa.int64()))
            arrays = [pa.array(c, pa.int64() if n == "content_length" else pa.string()) for c, n in zip(made, names, strict=True)]
            yield pa.record_batch([twice, *arrays], names=["key", *names])

    return read.mapInArrow(run, f"key {kind}, {SCHEMA}")


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (``page_id, url, html``), as a crawl would have them."""
    md5 = F.md5(F.concat_ws(" ", F.col("url"), F.col("page_id").cast("string")))
    pieces = [F.substring(md5, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    return pages.select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length).alias("headers"),
        F.col("html").alias("payload"),
    )


def write(records: DataFrame, path: str) -> None:
    """The records as compressed WARC files, one a task, in ``path``.  The writer ends each record
    with the second of its two line ends."""
    lines = records.select(F.expr("substring(record, 1, length(record) - 2)").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
