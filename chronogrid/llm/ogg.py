"""Media columns: Ogg containers.

Reading verifies every page's checksum, demultiplexes the logical streams by
serial number, reassembles packets from lacing values (packets may continue over
pages) and derives timestamps from granule positions. A page with a wrong
checksum, or bytes that are no page, is skipped and counted; a packet that lacks
a part through that is dropped and counted as broken.

Cases: null, empty or foreign bytes give no packets and a probe of zeros; a
stream without a known sample rate has null timestamps; repeated rows each get
their rows, and so does each of several media with one id; a medium is held whole in
a task, one at a time beside the Arrow batch it came in; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, per_batch

# Fixed values of the container format (RFC 3533).
CAPTURE = b"OggS"
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

#: First packet of a stream of raw samples: magic, bits, channels, rate.
PCM_HEAD = struct.Struct("<8sBBI")
PCM_MAGIC = b"PCMRAW  "
INDEX_HEAD = b"INDEX   "
RATE = 8000

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of the container: the usual polynomial, most significant bit first, from 0, no final inversion.

    That is zlib's CRC over bit-reversed bytes, itself bit-reversed.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: memoryview


@dataclass
class Packet:
    serial: int
    number: int
    page: int
    data: bytes
    granule: int  # of the page on which it ends if it is the last to end there, else -1


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    broken: int = 0
    ended: bool = False

    def rate(self) -> int | None:
        """Samples a second, if the first packet is a known head."""
        head = self.packets[0].data if self.packets else b""
        if head[:8] == PCM_MAGIC and len(head) >= PCM_HEAD.size:
            return PCM_HEAD.unpack_from(head)[3] or None
        if head[:7] == b"\x01vorbis" and len(head) >= 16:
            return struct.unpack_from("<I", head, 12)[0] or None
        if head[:8] == b"OpusHead":
            return 48000
        return None


def make_page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    raw = HEAD.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return raw[:22] + checksum(raw).to_bytes(4, "little") + raw[26:]


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; each packet comes with its granule position. The first packet, a head, has the first page for itself."""
    segments = [(n, i, k == len(data) // 255) for i, (data, _) in enumerate(packets) for k, n in enumerate([255] * (len(data) // 255) + [len(data) % 255])]
    body = b"".join(data for data, _ in packets)
    out, at = [], 0
    head = len(packets[0][0]) // 255 + 1 if packets else 0
    bounds = [*range(0, head, 255), *range(head, len(segments), 255), len(segments)]
    for first, end in itertools.pairwise(bounds):
        part = segments[first:end]
        ends = [i for _, i, last in part if last]
        flags = CONTINUED if first and not segments[first - 1][2] else 0
        flags |= (FIRST if not first else 0) | (LAST if end == len(segments) else 0)
        size = sum(n for n, _, _ in part)
        out.append(make_page(serial, len(out), flags, packets[ends[-1]][1] if ends else NO_GRANULE, bytes(n for n, _, _ in part), body[at : at + size]))
        at += size
    return out


def multiplex(streams: list[list[bytes]]) -> bytes:
    """First pages of all streams, then their other pages in turn."""
    out = [pages[0] for pages in streams if pages]
    most = max((len(p) for p in streams), default=0)
    return b"".join(out + [pages[k] for k in range(1, most) for pages in streams if k < len(pages)])


def parse_pages(data: bytes) -> Iterator[Page | None]:
    """Pages in order; None for each stretch or page that is not valid."""
    at, lost = 0, False
    view = memoryview(data)
    while True:
        found = data.find(CAPTURE, at)
        if found != at and at < len(data) and not lost:
            yield None
        if found < 0:
            return
        lost = True
        at = found + 1
        if found + HEAD.size > len(data):
            yield None
            continue
        _, version, flags, granule, serial, sequence, crc, count = HEAD.unpack_from(data, found)
        start = found + HEAD.size + count
        lacing = data[found + HEAD.size : start]
        end = start + sum(lacing)
        if version or len(lacing) < count or end > len(data) or checksum(data[found : found + 22] + b"\0\0\0\0" + data[found + 26 : end]) != crc:
            yield None
            continue
        yield Page(flags, granule, serial, sequence, lacing, view[start:end])
        at, lost = end, False


def demultiplex(data: bytes | None) -> tuple[dict[int, Stream], int]:
    """Streams by serial number, with their packets, and the count of bad pages."""
    streams: dict[int, Stream] = {}
    open_parts: dict[int, list[bytes] | None] = {}
    next_sequence: dict[int, int] = {}
    bad = 0
    for page in parse_pages(data or b""):
        if page is None:
            bad += 1
            continue
        s = streams.setdefault(page.serial, Stream(page.serial))
        gap = next_sequence.get(page.serial, page.sequence) != page.sequence
        next_sequence[page.serial] = page.sequence + 1
        s.pages += 1
        s.ended |= bool(page.flags & LAST)
        parts = open_parts.get(page.serial)
        if page.flags & CONTINUED:
            if gap or parts is None:
                s.broken += 1
                parts = None
                skipping = True
            else:
                skipping = False
        else:
            s.broken += parts is not None
            parts, skipping = [], False
        if parts is None:
            parts = []
        done: list[Packet] = []
        at, length = 0, 0
        for n in page.lacing:
            length += n
            if n < 255:
                if skipping:
                    skipping = False
                else:
                    parts.append(bytes(page.body[at : at + length]))
                    done.append(Packet(page.serial, len(s.packets) + len(done), page.sequence, b"".join(parts), NO_GRANULE))
                parts, at, length = [], at + length, 0
        if done:
            done[-1].granule = page.granule
        s.packets += done
        if page.lacing and page.lacing[-1] == 255:
            parts.append(bytes(page.body[at:]))
            open_parts[page.serial] = None if skipping else parts
        else:
            open_parts[page.serial] = None
    for serial, parts in open_parts.items():
        streams[serial].broken += parts is not None
    return streams, bad


def timestamp_us(stream: Stream, packet: Packet) -> int | None:
    """Microseconds at the packet's end, from its page's granule position."""
    rate = stream.rate()
    return None if rate is None or packet.granule < 0 else packet.granule * 1_000_000 // rate


def read_packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per packet of each medium."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            streams, _ = demultiplex(data)
            rows += [(i, s.serial, p.number, p.page, len(p.data), p.granule if p.granule >= 0 else None, timestamp_us(s, p), p.data) for s in streams.values() for p in s.packets]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["media_id", "serial", "packet", "page", "n_bytes", "granule", "timestamp_us", "data"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names) if rows else None

    media = df.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).cast("binary").alias("media"))
    return per_batch(media, run, "media_id long, serial long, packet int, page int, n_bytes long, granule long, timestamp_us long, data binary")


def probe(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per medium: streams, pages, packets, bad pages, broken packets, whether all streams ended, longest time."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column(1).to_pylist():
            streams, bad = demultiplex(data)
            every = streams.values()
            times = [t for s in every for p in s.packets[-1:] if (t := timestamp_us(s, p)) is not None]
            rows.append((len(streams), sum(s.pages for s in every), sum(len(s.packets) for s in every), bad, sum(s.broken for s in every), bool(streams) and all(s.ended for s in every), max(times, default=None)))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["media_id", "streams", "pages", "packets", "bad_pages", "broken_packets", "complete", "duration_us"])

    media = df.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).cast("binary").alias("media"))
    return per_batch(media, run, "media_id long, streams int, pages int, packets int, bad_pages int, broken_packets int, complete boolean, duration_us long")


def store_samples(payload: bytes, packet_samples: int = 4096) -> bytes:
    """8-bit samples as one logical stream, with an index stream beside it; serials follow from the payload."""
    serial = zlib.crc32(payload)
    packets = [(PCM_HEAD.pack(PCM_MAGIC, 8, 1, RATE), 0)]
    packets += [(payload[k : k + packet_samples], min(len(payload), k + packet_samples)) for k in range(0, len(payload), packet_samples)]
    index = [(INDEX_HEAD, 0), (struct.pack("<QI", len(payload), len(packets) - 1), len(payload))]
    return multiplex([pages_of(serial, packets), pages_of(serial ^ 0xFFFFFFFF, index)])


def load_samples(media: bytes) -> tuple[bytes, str]:
    """The samples of a stored medium, checked against its index, and a feature string."""
    streams, bad = demultiplex(media)
    sound = next(s for s in streams.values() if s.packets and s.packets[0].data[:8] == PCM_MAGIC)
    index = next(s for s in streams.values() if s.packets and s.packets[0].data[:8] == INDEX_HEAD)
    samples = b"".join([p.data for p in sound.packets[1:]])
    size, count = struct.unpack("<QI", index.packets[1].data)
    if bad or size != len(samples) or count != len(sound.packets) - 1:
        raise ValueError("a stored medium does not read back whole")
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return samples, f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};rate={sound.rate()};duration_us={timestamp_us(sound, sound.packets[-1])};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def pad(data: bytes, unit: int = 192) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b" ")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored medium: media_id, media."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([store_samples(pad(t.encode())) for t in batch.column(1).to_pylist()], pa.binary())], names=["media_id", "media"])

    return per_batch(id_text(df, id_col, text_col), run, "media_id long, media binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a medium, read the stored bytes back and digest both."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            raw = text.encode()
            media = store_samples(pad(raw))
            payload, feature = load_samples(media)
            rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return per_batch(id_text(df, id_col, text_col), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
