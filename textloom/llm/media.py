"""Media columns in Ogg: write texts as 8-bit samples, read them back with every check.

A stored item is a physical Ogg stream of two multiplexed logical streams. Stream 1 carries the
samples, 8000 a second, in packets of 1920; its granule position counts samples. Stream 2 carries a
table of the packet lengths, one packet for each data page, with the same clock. The reader checks
capture pattern, version, page sequence and CRC of each page, reassembles packets from the lacing
values (across pages too), demultiplexes by serial number and derives timestamps from granules.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import prepare, utf8

RATE, PACKET, UNIT = 8000, 1920, 192
AUDIO, INDEX = 1, 2
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_ID = b"tl8bit\0\1" + struct.pack("<II", RATE, PACKET)
_ID_INDEX = b"tlindex\1"


def ogg_crc(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no inversion: the bit-reversed
    twin of zlib's, so bytes and result are reversed and the inversions undone."""
    x = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = ogg_crc(head + body)
    return b"".join((head[:22], struct.pack("<I", crc), head[26:], body))


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def encode(payload: bytes) -> bytes:
    """payload (a multiple of UNIT bytes) as an Ogg file; the same bytes for the same payload."""
    pages = [_page(2, 0, AUDIO, 0, _lacing(len(_ID)), _ID), _page(2, 0, INDEX, 0, _lacing(len(_ID_INDEX)), _ID_INDEX)]
    lacing, body, granule, number, told = bytearray(), bytearray(), -1, 1, 1
    done, flags, lengths = 0, 0, []

    def flush(last: bool, cut: bool) -> None:
        nonlocal lacing, body, granule, number, told, flags, lengths
        pages.append(_page(flags | 4 * last, granule, AUDIO, number, bytes(lacing), bytes(body)))
        table = struct.pack(f"<{len(lengths)}H", *lengths)
        pages.append(_page(4 * last, done, INDEX, told, _lacing(len(table)), table))
        lacing, body, granule, number, told, flags, lengths = bytearray(), bytearray(), -1, number + 1, told + 1, cut, []

    for at in range(0, len(payload), PACKET):
        packet = payload[at : at + PACKET]
        values, used = _lacing(len(packet)), 0
        while len(lacing) + len(values) > 255:  # the packet goes on in the next page
            room = 255 - len(lacing)
            lacing += values[:room]
            body += packet[used : used + 255 * room]
            used, values = used + 255 * room, values[room:]
            flush(False, room > 0)
        lacing += values
        body += packet[used:]
        done += len(packet)
        granule = done
        lengths.append(len(packet))
    flush(True, False)
    return b"".join(pages)


class BadOgg(ValueError):
    pass


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """flags, granule, serial, number, lacing and body of each page, after all checks."""
    at, expected = 0, {}
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise BadOgg("truncated header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise BadOgg("no capture pattern")
        body_at = at + _HEAD.size + n
        lacing = data[at + _HEAD.size : body_at]
        end = body_at + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise BadOgg("truncated page")
        if ogg_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise BadOgg("page checksum")
        if number != expected.get(serial, 0) or bool(flags & 2) != (serial not in expected):
            raise BadOgg("page sequence")
        expected[serial] = number + 1
        yield flags, granule, serial, number, lacing, data[body_at:end]
        at = end


def demultiplex(data: bytes) -> dict[int, dict]:
    """By serial: packets, page count, pages that begin inside a packet, last granule, whether it ended."""
    streams: dict[int, dict] = {}
    for flags, granule, serial, _, lacing, body in pages(data):
        s = streams.setdefault(serial, {"packets": [], "part": None, "pages": 0, "continued": 0, "granule": 0, "ended": False})
        if s["ended"]:
            raise BadOgg("page after the end")
        if bool(flags & 1) != (s["part"] is not None):
            raise BadOgg("continuation")
        s["pages"] += 1
        s["continued"] += flags & 1
        s["ended"] = bool(flags & 4)
        if granule >= 0:
            if granule < s["granule"]:
                raise BadOgg("granules run backwards")
            s["granule"] = granule
        part, at, run = s["part"] or b"", 0, 0
        for v in lacing:
            run += v
            if v < 255:
                s["packets"].append(part + body[at : at + run])
                at, run, part = at + run, 0, b""
        s["part"] = part + body[at:] if lacing and lacing[-1] == 255 else None
    if any(s["part"] is not None or not s["ended"] for s in streams.values()):
        raise BadOgg("a stream has no end")
    return streams


def decode(data: bytes) -> tuple[bytes, dict]:
    """The payload, and what the container says about it."""
    streams = demultiplex(data)
    audio, index = streams[AUDIO], streams[INDEX]
    if audio["packets"][0] != _ID or index["packets"][0] != _ID_INDEX:
        raise BadOgg("identification")
    payload = b"".join(audio["packets"][1:])
    lengths = struct.unpack(f"<{sum(map(len, index['packets'][1:])) // 2}H", b"".join(index["packets"][1:]))
    if [*lengths] != [len(p) for p in audio["packets"][1:]] or audio["granule"] != len(payload):
        raise BadOgg("lengths or granules differ from the samples")
    seen = {
        "streams": len(streams), "pages": sum(s["pages"] for s in streams.values()), "packets": len(lengths), "continued": audio["continued"],
        "granule": audio["granule"], "ms": audio["granule"] * 1000 // RATE, "last_ms": (audio["granule"] - lengths[-1]) * 1000 // RATE,
    }
    return payload, seen


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b" " * (-len(raw) % unit or (unit if not raw else 0))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; other columns ignored) -> doc_id, media: the stored Ogg file of each whole text (null:
    empty), one row a row; equal texts give equal files, an empty table gives an empty result."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(pad(x)) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", utf8().alias("raw")).mapInArrow(run, "doc_id long, media binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back, and describe what was read.

    Null and empty texts become one unit of spaces. Rows are independent: null ids, ties and repeated
    rows need no rule, equal texts give equal values, an empty table gives an empty result. Damaged
    bytes raise BadOgg. Columns other than doc_id and text are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(1).to_pylist():
                media = encode(pad(raw))
                payload, seen = decode(media)
                n = len(raw)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), ";".join(f"{k}={v}" for k, v in seen.items())))
            cols = [*zip(*rows, strict=True)] or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    return docs.select("doc_id", utf8().alias("raw")).mapInArrow(run, SCHEMA)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
