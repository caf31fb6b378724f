"""Media columns: 8-bit sound in Ogg, written and read back page by page.

A payload goes into an Ogg file of two logical streams: `pcm8` holds a header packet and the samples in packets, its
granule positions counting samples; `note` holds a packet with the length of what was padded. The reader checks every
page's checksum, goes on at the next capture pattern after a page that fails, joins packets from the lacing values
over as many pages as they take, keeps the streams apart by serial number, and gives packets their times from the
granule position of the page on which they end.

Cases: a null or empty text is a payload of 64 zero bytes; equal texts give equal media, for serial numbers come from
the payload; of media whose pages fail, the packets that are whole come back, with the number of bytes skipped;
a null medium has no packets; rows that repeat an id each get theirs; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, small_batches, utf8

RATE = 8000
PACKET = 48000
PAD = 64
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 04C11DB7, most significant bit first, from zero. It is zlib's with all bits reversed."""
    own = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(own.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def pages_of(packets: list[tuple[bytes, int]], serial: int, first: int = 0, last: bool = True) -> list[bytes]:
    """Pages of a logical stream from (packet, granule position at its end); `first` is the first page's number."""
    segments: list[tuple[int, int]] = []  # lacing value, granule position or -1
    for packet, granule in packets:
        full, rest = divmod(len(packet), 255)
        segments += [(255, -1)] * full + [(rest, granule)]
    data, at, out, open_ = b"".join(p for p, _ in packets), 0, [], False
    for i in range(0, len(segments), 255):
        own = segments[i : i + 255]
        size = sum(s for s, _ in own)
        ended = [g for _, g in own if g >= 0]
        flags = CONTINUED * open_ | FIRST * (first + len(out) == 0) | LAST * (last and i + 255 >= len(segments))
        out.append(_page(flags, ended[-1] if ended else -1, serial, first + len(out), bytes(s for s, _ in own), data[at : at + size]))
        at, open_ = at + size, own[-1][1] < 0
    return out


def encode(payload: bytes, note: int) -> bytes:
    """An Ogg file of a payload; note: its length before padding."""
    serial = zlib.crc32(payload)
    sound = [(b"pcm8mono" + struct.pack("<I", RATE), 0)]
    body = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    notes = [(b"note" + struct.pack("<qq", note, len(payload)), 0)]
    return b"".join(pages_of(sound, serial, 0, False) + pages_of(notes, serial ^ 0xA5A5A5A5) + pages_of(body, serial, 1))


def decode(media: bytes) -> tuple[dict[int, list[tuple[bytes, int, int]]], int, int]:
    """(serial -> [(packet, page's granule position, packets that end after it on that page)], pages, bytes skipped)."""
    streams: dict[int, list[tuple[bytes, int, int]]] = {}
    partial: dict[int, tuple[int, list[bytes]]] = {}  # number of the last page, pieces of a packet that goes on
    at = pages = skipped = 0
    while at < len(media):
        size = _size(media, at)
        if not size:
            after = media.find(b"OggS", at + 1)
            skipped += (after if after >= 0 else len(media)) - at
            at = after if after >= 0 else len(media)
            continue
        _, _, flags, granule, serial, number, _, n = _HEAD.unpack_from(media, at)
        lacing, body = media[at + 27 : at + 27 + n], at + 27 + n
        before, pieces = partial.pop(serial, (number - 1, []))
        lost = bool(flags & CONTINUED) and (not pieces or before != number - 1)  # the packet's start is missing
        if not flags & CONTINUED or lost:
            pieces = []
        ended, start = [], body
        for value in lacing:
            body += value
            if value < 255:
                pieces.append(media[start:body])
                if not lost:
                    ended.append(b"".join(pieces))
                pieces, start, lost = [], body, False
        if start < body and not lost or lacing.endswith(b"\xff") and not lost:
            pieces.append(media[start:body])
            partial[serial] = (number, pieces)
        streams.setdefault(serial, []).extend((p, granule, len(ended) - 1 - i) for i, p in enumerate(ended))
        pages += 1
        at += size
    return streams, pages, skipped


def _size(media: bytes, at: int) -> int:
    """Size of the page at `at`; 0 if none is there or its checksum fails."""
    if media[at : at + 5] != b"OggS\0" or at + 27 > len(media):
        return 0
    n = media[at + 26]
    size = 27 + n + sum(media[at + 27 : at + 27 + n])
    page = media[at : at + size]
    good = len(page) == size and checksum(page[:22] + b"\0\0\0\0" + page[26:]) == struct.unpack_from("<I", page, 22)[0]
    return size if good else 0


def read_sound(media: bytes) -> dict:
    """Payload, length before padding, times of packets in seconds, and what the pages were like."""
    streams, pages, skipped = decode(media)
    payload, times, note, packets, last = [], [], None, 0, 0
    for stream in streams.values():
        kinds = stream[0][0][:4]
        packets += len(stream)
        if kinds == b"note":
            note = struct.unpack_from("<q", stream[0][0], 4)[0]
        elif kinds == b"pcm8" or len(streams) == 1:
            sound = stream[1:] if kinds == b"pcm8" else stream
            for k, (packet, granule, after) in enumerate(sound):
                later = sum(len(p) for p, _, _ in sound[k + 1 : k + 1 + after])  # end on the same page
                times.append((granule - later - len(packet)) / RATE)
                payload.append(packet)
            last = max([0, *[g for _, g, _ in sound]])
    return {"payload": b"".join(payload), "note": note, "starts": times, "seconds": last / RATE, "packets": packets, "pages": pages, "skipped": skipped}


def _encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        media = []
        for t in binary_values(batch.column(1)):
            media.append(encode(t + bytes(-len(t) % PAD if t else PAD), len(t)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["_id", "media"])


_READ = "_id long, media binary, n_bytes long, payload binary, starts array<double>, seconds double, packets int, pages int, skipped long"


def _decoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        own = [read_sound(m) for m in binary_values(batch.column(1))]
        cols = [
            pa.array([r["note"] for r in own], pa.int64()),
            pa.array([r["payload"] for r in own], pa.binary()),
            pa.array([r["starts"] for r in own], pa.list_(pa.float64())),
            pa.array([r["seconds"] for r in own], pa.float64()),
            *[pa.array([r[k] for r in own], t) for k, t in (("packets", pa.int32()), ("pages", pa.int32()), ("skipped", pa.int64()))],
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["_id", "media", "n_bytes", "payload", "starts", "seconds", "packets", "pages", "skipped"])


def to_ogg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, media): each text's bytes, padded with zeros to a positive multiple of PAD, as an Ogg file."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("_id"), utf8(text_col).alias("_text")).mapInArrow(_encoded, "_id long, media binary")


def from_ogg(media: DataFrame) -> DataFrame:
    """What _READ lists for each row of (_id, media)."""
    return media.mapInArrow(_decoded, _READ)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    read = from_ogg(to_ogg(docs, id_col, text_col))
    return read.select(
        F.col("_id").alias(id_col),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -PAD, PAD)).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("ogg pages=%d packets=%d seconds=%.6f last_start=%.6f", "pages", "packets", "seconds", F.element_at("starts", -1)).alias("feature"),
    )
