"""WARC derivatives: linked metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import blocks

VERSION = "WARC/1.1"
#: Pages carry no fetch time; records of a crawl without one get this.
DATE = "2024-01-01T00:00:00Z"
TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.S | re.I)
LANG = re.compile(r"""<html[^>]*?\slang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
CHARSET = re.compile(r"^content-type:.*charset=[\"']?([A-Za-z0-9_.:-]+)", re.I)
#: What a page holds without showing it, and where no link counts.
UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
LINK = re.compile(r"""<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A urn:uuid that only the parts decide, so a record made again keeps its name."""
    raw = hashlib.sha1("\0".join("" if p is None else str(p) for p in parts).encode("utf-8")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=raw[:16], version=5)}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "\r\n".join([VERSION, *(f"{k}: {one_line(v)}" for k, v in headers)])
    return head.encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one serialised record. A record without its whole block is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers.get("Content-Length") or 0)
    if len(rest) < size:
        raise ValueError(f"a WARC record has {len(rest)} of {size} bytes")
    return headers, rest[:size]


def body_of(http: list[str], payload: bytes) -> bytes:
    """The page's bytes: without the chunks and the compression that the HTTP header names. What is broken stays."""
    said = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in http[1:])}
    if said.get("transfer-encoding") == "chunked":
        out, at = b"", 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            try:
                n = int(payload[at:end].split(b";")[0], 16)
            except ValueError:
                return payload
            out += payload[end + 2 : end + 2 + n]
            at = end + 4 + n
            if not n:
                break
        payload = out
    if said.get("content-encoding") in ("gzip", "deflate"):
        try:
            return zlib.decompressobj(47 if said["content-encoding"] == "gzip" else 15).decompress(payload)
        except zlib.error:
            return payload
    return payload


def decoded(http: list[str], payload: bytes) -> str:
    charset = next((m[1] for x in http if (m := CHARSET.search(x))), "utf-8")
    try:
        return payload.decode(charset, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[list[tuple[str, str]], bytes]:
    """The response record of a page: an HTTP header and the page's bytes."""
    payload = (html or "").encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return headers, block


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response.

    Both refer to the response by its id and keep its target, date and payload digest. The metadata's fields hold the
    source's HTTP status and header, title, language, links in page order, and the id and digest of the conversion; the
    conversion's block is the page's whole visible text, a line for each block."""
    source = dict(headers)
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")
    html = decoded(lines, body_of(lines, payload))
    text = "\n".join(t for t, _ in blocks(html, everything=True)).encode("utf-8")
    linked = [("WARC-Refers-To", source["WARC-Record-ID"]), ("WARC-Refers-To-Target-URI", source["WARC-Target-URI"]), ("WARC-Refers-To-Date", source["WARC-Date"]), ("WARC-Target-URI", source["WARC-Target-URI"]), ("WARC-Date", source["WARC-Date"]), ("WARC-Source-Payload-Digest", source["WARC-Payload-Digest"])]

    def made(kind: str, content: str, data: bytes):
        name = record_id(kind, source["WARC-Record-ID"], digest(data))
        return [("WARC-Type", kind), ("WARC-Record-ID", name), *linked, ("Content-Type", content), ("WARC-Block-Digest", digest(data)), ("Content-Length", str(len(data)))], data

    conversion = made("conversion", "text/plain; charset=utf-8", text)
    title, lang = TITLE.search(html), LANG.search(html)
    fields = [("http-status", lines[0].split(" ", 1)[1] if " " in lines[0] else ""), *((f"http-{k.lower()}", v) for k, _, v in (x.partition(": ") for x in lines[1:]) if k)]
    fields += [("title", unescape(title[1]) if title else ""), ("language", lang[1].lower() if lang else "")]
    fields += [("outlink", unescape(m[1] or m[2] or m[3] or "")) for m in LINK.finditer(UNSEEN.sub(" ", html))]
    fields += [("conversion-id", dict(conversion[0])["WARC-Record-ID"]), ("conversion-digest", digest(text))]
    metadata = made("metadata", "application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8"))
    return [metadata, conversion]


COLUMNS = [("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("record", pa.binary())]
DDL = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, payload_digest string, record binary"


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The response record of each row of pages (page_id, url, html) and the records derived from it, serialised.

    A row gives three rows. Null html is an empty page, a null url an empty target; equal rows give equal records with
    equal ids. Rows are independent, so nothing is shuffled; other columns are left behind. Empty table: no rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                source = response(page_id, url, html.as_py(), date)
                rows += [_row(page_id, *made) for made in [source, *derive(*source)]]
                if len(rows) >= 1024:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, DDL)


SEPARATOR = "\r\n\r\nWARC/1."


def read_records(spark, path: str) -> DataFrame:
    """(record) for each record of the WARC files below a path, plain or gzip-compressed, as its bytes.

    Spark's text source splits the files where a record begins, so plain files are read in parts; a gzip file is one part.
    Its rows are bytes as they are in the file, whatever their encoding. A block that holds the separator itself gives a
    record that lacks bytes, which derive_records() reports as an error."""
    rows = spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", True).text(path).where("value <> ''")
    raw = F.col("value").cast("binary")
    begins = F.lit("WARC/1.").cast("binary")
    return rows.select(F.when(F.startswith(raw, begins), raw).otherwise(F.concat(begins, raw)).alias("record"))


def derive_records(records: DataFrame) -> DataFrame:
    """The records derived from each response among records (record: bytes of one record), as derivatives() has them.

    page_id is null; records of other types and null ones give nothing. Rows are independent, so nothing is shuffled."""

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column("record"):
                if not raw.is_valid:
                    continue
                headers, block = parse(raw.as_py())
                if headers.get("WARC-Type") != "response":
                    continue
                headers = {"WARC-Target-URI": "", "WARC-Date": DATE, "WARC-Payload-Digest": digest(block.partition(b"\r\n\r\n")[2])} | headers
                rows += [_row(None, *made) for made in derive(list(headers.items()), block)]
                if len(rows) >= 1024:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return records.select("record").mapInArrow(run, DDL)


def _row(page_id: int | None, headers: list[tuple[str, str]], block: bytes) -> tuple:
    h = dict(headers)
    return (page_id, h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Target-URI"], h["Content-Type"], len(block), h["WARC-Block-Digest"], h.get("WARC-Payload-Digest", h.get("WARC-Source-Payload-Digest")), serialise(headers, block))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), COLUMNS, strict=True)], [n for n, _ in COLUMNS])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = derivatives(table(spark, sf_dir, "pages"))
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record")
