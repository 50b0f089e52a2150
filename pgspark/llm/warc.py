"""WARC derivatives: linked metadata and plain-text conversion records.

``responses`` makes response records from a table of pages, ``read_warc`` reads
them from WARC files, ``derive`` turns each response into a ``metadata`` and a
``conversion`` record that refer to it by its record id and keep its target URI,
date and payload digest, and ``write_warc`` writes records as WARC files, whatever
bytes their blocks hold: a record ends with two line ends, which is the line
separator of Spark's text writer. The metadata keep the HTTP fields of the source
in their order, repeated ones too, and the WARC fields that have no column.

Derivation is a map: one row in, two rows out, nothing shuffled or collected.
Record ids are name-based (from the page key or the parent's id and the type), so
a retried task makes the same records.

Files are read as text with the end of one record and the version line of the
next as the separator, so a large file is split among tasks and none is held
whole; gzip files, by record or as one, are read from front to end. Where a block
holds that separator itself, the pieces are put together again by Content-Length;
a block that does not end within its task's part of the file is an error, and
the file has to be read with a larger ``spark.sql.files.maxPartitionBytes``.

Defined results: a null url is an empty target URI; null or empty html gives an
empty payload and an empty conversion; repeated rows give repeated records, with
equal ids; extra columns are ignored; an empty table gives an empty result; a
payload that is not UTF-8 is decoded with replacement characters, its digest is
taken from the bytes. A chunked or compressed payload is decoded for the text; one
that does not decode is taken as it is.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The record fields in the order in which they are written.
FIELDS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}
RECORD = "record_id string, warc_type string, date string, target_uri string, refers_to string, block_digest string, payload_digest string, content_type string, content_length long, block binary, more array<struct<name:string,value:string>>"
COLUMNS = [x.strip().split(" ")[0] for x in RECORD.split(", ")]
CAPTURED = "2024-01-01T00:00:00Z"  # pages carry no date of their own
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|textarea|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>?", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
_HEADER = re.compile(rb"\r?\n\r?\n")
#: The end of a record and the beginning of the next.
SEPARATOR = "\r\n\r\nWARC/1."
MORE = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def plain_text(page: str) -> str:
    """The text of a page: hidden elements and markup out, one line per block; line ends of the page stay."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", page)))
    lines = (" ".join(x.split()) for x in entities.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 8 + [pa.int64(), pa.binary(), MORE]
    names = ["record_id", "warc_type", "date", "target_uri", "refers_to", "block_digest", "payload_digest", "content_type", "content_length", "block", "more"]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def responses(pages: DataFrame, key: str = "page_id", captured: str = CAPTURED) -> DataFrame:
    """A response record for every page, with the HTTP head that a server would send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url, text in zip(b[key].to_pylist(), b["url"].to_pylist(), b["html"]):
                payload = (text.as_py() or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                rows.append((name_id(f"response/{page_id}/{url or ''}"), "response", captured, url or "", None, digest_of(block), digest_of(payload), "application/http; msgtype=response", len(block), block, []))
            yield _records(rows)

    return pages.select(key, "url", "html").mapInArrow(run, RECORD)


def fields_of(lines: list[bytes]) -> list[tuple[str, str]]:
    """(name, value) of header lines, in order; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {_text(line.strip())}"
        elif b":" in line:
            name, _, value = line.partition(b":")
            out.append((_text(name.strip()), _text(value.strip())))
    return out


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def http_parts(block: bytes) -> tuple[bytes, list[tuple[str, str]], bytes]:
    """(status line, header fields in order, payload) of an HTTP response."""
    parts = _HEADER.split(block, maxsplit=1)
    lines = parts[0].splitlines() or [b""]
    return lines[0], fields_of(lines[1:]), parts[1] if len(parts) > 1 else b""


def decoded(payload: bytes, fields: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content encodings; as it is if they do not hold."""
    by_name = {k.lower(): v.lower() for k, v in fields}
    try:
        if "chunked" in by_name.get("transfer-encoding", ""):
            out, at = [], 0
            while size := int(payload[at : (end := payload.index(b"\r\n", at))].split(b";")[0], 16):
                out.append(payload[end + 2 : end + 2 + size])
                at = end + 4 + size
            payload = b"".join(out)
        for kind in reversed(by_name.get("content-encoding", "").replace(" ", "").split(",")):
            if kind in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif kind == "deflate":
                payload = zlib.decompress(payload)
    except (ValueError, OSError, EOFError, zlib.error):
        pass
    return payload


def derived(record: dict) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, fields, payload = http_parts(record["block"] or b"")
    parent, uri = record["record_id"], record["target_uri"]
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    page = decoded(payload, fields)
    try:
        page = page.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = page.decode("utf-8", "replace")
    text = plain_text(page).encode()
    source = [("http-status", status.decode("latin-1")), *[(f"http-{k.lower()}", v) for k, v in fields], *[(f"source-{x['name'].lower()}", x["value"]) for x in record["more"] or ()]]
    source += [("source-payload-digest", record["payload_digest"] or digest_of(payload)), ("source-block-digest", record["block_digest"] or ""), ("conversion-id", name_id(f"{parent}/conversion")), ("text-characters", str(len(text.decode())))]
    notes = "".join(f"{k}: {v}\r\n" for k, v in source).encode()
    return [
        (name_id(f"{parent}/metadata"), "metadata", record["date"], uri, parent, digest_of(notes), None, "application/warc-fields", len(notes), notes, []),
        (name_id(f"{parent}/conversion"), "conversion", record["date"], uri, parent, digest_of(text), record["payload_digest"] or digest_of(payload), "text/plain; charset=utf-8", len(text), text, []),
    ]


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records; other records are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                yield _records([x for r in b.slice(a, 500).to_pylist() for x in derived(r)])

    return records.where("warc_type = 'response'").select(*COLUMNS).mapInArrow(run, RECORD)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC/1.0 files, one file for each partition; blocks are written byte for byte."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(name, F.lit(": "), value))
    known = [line(F.lit(name), F.col(c).cast("string")) for c, name in FIELDS.items()]
    more = F.array_join(F.transform("more", lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "\r\n")
    head = F.concat_ws("\r\n", F.lit("WARC/1.0"), *known, F.nullif(more, F.lit("")))
    text = F.concat(head, F.lit("\r\n\r\n"), F.col("block").cast("string"))  # a cast keeps all bytes
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parsed(piece: bytes) -> tuple[tuple, int]:
    """(the record of one piece between separators, the bytes that its block still lacks)."""
    m = _HEADER.search(piece)
    head, rest = (piece[: m.start()], piece[m.end() :]) if m else (piece, b"")
    names = {v.lower(): k for k, v in FIELDS.items()}
    fields = fields_of(head.splitlines()[1:])  # the rest of the version line comes first
    known = {names[k.lower()]: v for k, v in fields if k.lower() in names}
    size = int(known["content_length"]) if known.get("content_length", "").isdigit() else len(rest.removesuffix(b"\r\n\r\n"))
    more = [{"name": k, "value": v} for k, v in fields if k.lower() not in names]
    row = tuple(known.get(k) for k in ("record_id", "warc_type", "date", "target_uri", "refers_to", "block_digest", "payload_digest", "content_type"))
    return (*row, size, rest[:size], more), size - len(rest)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; large files are split among tasks, gzip files are not."""
    separator = SEPARATOR.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = b""  # a piece whose block is not complete
        for b in batches:
            rows = []
            for piece in b["piece"].to_pylist():
                piece = held + separator + piece if held else piece
                row, lacking = parsed(piece)
                held = piece if lacking > 0 else b""
                if not held:
                    rows.append(row)
            yield _records(rows)
        if held:
            raise ValueError("a block does not end within its part of the file: raise spark.sql.files.maxPartitionBytes, or the file is cut off")

    pieces = spark.read.option("lineSep", SEPARATOR).text(path).where(F.length("value") > 0)
    return pieces.select(F.col("value").cast("binary").alias("piece")).mapInArrow(run, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select("record_id", "warc_type", "target_uri", "refers_to", "block_digest", "payload_digest", "content_length", F.decode("block", "UTF-8").alias("content"))
