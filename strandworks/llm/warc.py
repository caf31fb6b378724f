"""WARC archives of pages, and a reader that salvages what damage leaves.

The writer makes one gzip member for each record: a page is a `response` with an HTTP head and its payload, or a
`revisit` with the head alone where another page with the same payload is the response. The reader checks member,
version line, header fields, lengths and digest. After a check fails it looks for the next place where a member or a
version line begins a record that passes, recovers from there, and logs the bytes between as quarantined. In a member
that inflates but holds a record that fails, it looks for the next version line inside and logs a gap of no bytes that
names the inflated ones. Names of header fields are read in any case, with or without a space after the colon; digests
are checked where there are any.

Archives and payloads are cells of a binary column, so none can be over 2 GiB: a member that inflates to more is logged
as a gap.

Cases: a null html is an empty payload; of equal payloads the largest page_id is the response, and rows that repeat
that page_id are responses too; a null page_id is the response only where all of its equals are null; a null url
gives a record without a target; a revisit without a payload digest has a null one; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, utf8

#: Bytes of an archive after which the next one begins.
ARCHIVE_BYTES = 4 << 20
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_LIMIT = 1 << 31


class Record(NamedTuple):
    offset: int
    size: int
    fields: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    offset: int
    size: int
    why: str


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _record(fields, block)


def compress(record: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A member's bytes and its end; raises ValueError if it isn't whole."""
    d, out, size, fed = zlib.decompressobj(31), [], 0, at
    try:
        while not d.eof and fed < len(data):
            out.append(d.decompress(data[fed : fed + 65536]))
            fed = min(len(data), fed + 65536)
            size += len(out[-1])
            if size > _LIMIT:
                raise ValueError("member too long")
    except zlib.error as e:
        raise ValueError(f"member: {e}") from None
    if not d.eof:
        raise ValueError("member: cut short")
    return b"".join(out), fed - len(d.unused_data)


def _parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record that begins at `at`; raises ValueError if a check fails."""
    if data[at : at + 7] != _VERSION:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header: no end")
    try:
        lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode()).split("\r\n")[1:]
    except UnicodeDecodeError:
        raise ValueError("header: not UTF-8") from None
    if any(":" not in x for x in lines):
        raise ValueError("header: not a field")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdecimal()) or len(length) > 12:
        raise ValueError("header: no length")
    begin, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("length: no end of record there")
    block = data[begin:stop]
    told = fields.get("warc-block-digest", "")
    if told.lower().startswith("sha1:") and told[5:].upper() != digest(block):
        raise ValueError("digest differs")
    return fields, block, stop + 4


def _inside(text: bytes, at: int, size: int) -> tuple[list[Record], list[Gap]]:
    """Records of a member that inflated to text, and gaps of no bytes where some of it can't be read; at least one record."""
    records, gaps, here, why = [], [], 0, ""
    while here < len(text):
        try:
            fields, block, stop = _parsed(text, here)
            records.append(Record(at, size, fields, block))
        except ValueError as e:
            why = str(e)
            stop = text.find(_VERSION, here + 1)
            stop = stop if stop >= 0 else len(text)
            gaps.append(Gap(at, 0, f"in the member, inflated bytes {here} to {stop}: {why}"))
        here = stop
    if not records:
        raise ValueError(why or "member: empty")
    return records, gaps


def _read_at(data: bytes, at: int) -> tuple[list[Record], list[Gap], int]:
    """Records and inner gaps of what begins at `at`, and its end; raises ValueError if there is no good record."""
    if data[at : at + 3] == _MEMBER:
        text, end = _inflate(data, at)
        return *_inside(text, at, end - at), end
    fields, block, stop = _parsed(data, at)
    return [Record(at, stop - at, fields, block)], [], stop


def salvage(data: bytes) -> tuple[list[Record], list[Gap]]:
    """Records of an archive, compressed or not, and the gaps in which none could be read."""
    records, gaps, at = [], [], 0
    begins = None
    while at < len(data):
        try:
            found, inner, end = _read_at(data, at)
        except ValueError as e:
            why, bad = str(e), at
            begins = begins or re.compile(rb"\x1f\x8b\x08|WARC/1\.")
            at += 1
            while (m := begins.search(data, at)) is not None:
                try:
                    found, inner, end = _read_at(data, m.start())
                    break
                except ValueError:
                    at = m.start() + 1
            else:
                gaps.append(Gap(bad, len(data) - bad, why))
                break
            gaps.append(Gap(bad, m.start() - bad, why))
        records += found
        gaps += inner
        at = end
    return records, gaps


def _written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def archive() -> pa.RecordBatch:
        data = b"".join(held)
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{hashlib.sha1(data).hexdigest()[:16]}.warc.gz"]), pa.array([data], pa.binary())], names=["archive", "data"])

    held, size = [], 0
    for batch in it:
        for page_id, url, payload, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns]):
            held.append(compress(page_record(page_id, url, payload, refers_to, revisit)))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                held, size = [], 0
    if held:
        yield archive()


_RECORDS = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def _id(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def _page(archive: str, r: Record) -> dict:
    head, _, payload = r.block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length: (\d+)", head)
    f, revisit = r.fields, r.fields.get("warc-type") == "revisit"
    told = re.fullmatch(r"(?i)sha1:([a-z2-7]+)", f.get("warc-payload-digest", ""))
    return {
        "archive": archive, "offset": r.offset, "size": r.size, "record_type": f.get("warc-type"), "page_id": _id(f.get("warc-record-id")), "url": f.get("warc-target-uri"),
        "payload_bytes": int(length[1]) if revisit and length else len(payload), "payload_digest": (told[1].upper() if told else None) if revisit else digest(payload),
        "refers_to": _id(f.get("warc-refers-to")), "payload": None if revisit else payload,
    }


def _salvaged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            records, gaps = salvage(data or b"")
            rows = [{"archive": name, "offset": g.offset, "size": g.size, "gap": g.why} for g in gaps]
            rows += [_page(name, r) for r in records if r.fields.get("warc-type") in ("response", "revisit")]
            for i in range(0, len(rows), 512):
                yield pa.RecordBatch.from_pylist(rows[i : i + 512], schema=_RECORDS)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, data): all pages as WARC archives of about ARCHIVE_BYTES. Payloads are not moved to find their equals."""
    small_batches(pages.sparkSession, 500)
    base = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), utf8(html_col).alias("_payload")).withColumn("_sha", F.sha1("_payload"))
    equal = base.groupBy("_sha").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha", "_first")
    revisit = F.coalesce(~F.col("_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    marked = base.join(equal, "_sha", "left").select("_id", "_url", "_payload", "_first", revisit.alias("_revisit"))
    return marked.mapInArrow(_written, "archive string, data binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """Recovered records and, with the reason in `gap`, quarantined ranges of bytes."""
    schema = "archive string, offset long, size long, gap string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return archives.mapInArrow(_salvaged, schema)


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, data) of the files under a path, each a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))


def save_archives(archives: DataFrame, folder: str) -> None:
    """Each row of (archive, data) as a file in a folder that all executors share. A task run again writes the same files."""

    def save(rows) -> None:
        for r in rows:
            part = os.path.join(folder, f".{r.archive}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(r.data)
            os.replace(part, os.path.join(folder, r.archive))

    os.makedirs(folder, exist_ok=True)
    archives.select("archive", "data").foreachPartition(save)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages, from archives written to the shared folder and read back."""
    records = read_archives(cut(write_archives(pages, id_col, url_col, html_col)))
    return records.where("gap IS NULL").select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
