"""MPEG audio as a column: written, resynchronised, checked and indexed without decoding."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_of

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by index for (MPEG-1?, layer), samples a second by version bits, samples
# a frame by (MPEG-1?, layer).
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
CRC = 0x8005
#: Bits of a subband's allocation code in layer II, as (subbands, bits) runs: of MPEG-1 by the kbit/s of a channel and the
#: sampling rate (see _layer2), and of the lower rates of 13818-3.
LAYER2 = {"a": ((3, 4), (8, 4), (12, 3), (4, 2)), "b": ((3, 4), (8, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}

#: The stored form: MPEG-1 layer III, 32 kHz, mono. Side information of 17 zero bytes declares no coded audio, so what follows
#: in a frame is ancillary data, and there the payload stands. Frames are 320 kbit/s but for the last, the least that fits.
STORED_KBITS, STORED_HERTZ, STORED_SIDE = KBITS[True, 3], 32000, 17


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ CRC) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8) & 0xFFFF ^ CRC_TABLE[c >> 8 ^ b]
    return c


def crc16_bits(data: bytes, bits: int, start: int = 0xFFFF) -> int:
    """Of the first bits of data, which need not fill a byte."""
    c = start
    for b in data[: bits // 8]:
        c = (c << 8) & 0xFFFF ^ CRC_TABLE[c >> 8 ^ b]
    for k in range(bits % 8):
        high = (c >> 15) ^ (data[bits // 8] >> (7 - k) & 1)
        c = (c << 1) & 0xFFFF ^ (CRC if high else 0)
    return c


@dataclass(frozen=True)
class Header:
    mpeg1: bool
    layer: int
    protected: bool
    kbits: int
    hertz: int
    padding: int
    mono: bool
    samples: int
    size: int
    side: int  # bytes of layer III side information
    bound: int = 32  # subbands of layers I and II that the channels don't share, in joint stereo

    @property
    def kind(self) -> tuple:
        """What all frames of a stream share."""
        return self.mpeg1, self.layer, self.hertz, self.mono


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format frames (bit-rate index 0) have no length of their own: None."""
    if four not in _HEADERS:
        if len(_HEADERS) > 50_000:
            _HEADERS.clear()
        _HEADERS[four] = _header(four)
    return _HEADERS[four]


def _header(b: bytes) -> Header | None:
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hertz = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3 or b[3] & 3 == 2:
        return None
    mpeg1, padding, mono = version == 3, b[2] >> 1 & 1, b[3] >> 6 == 3
    kbits, hz, samples = KBITS[mpeg1, layer][rate], HERTZ[version][hertz], SAMPLES[mpeg1, layer]
    size = (12 * kbits * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hz + padding
    side = (17 if mono else 32) if mpeg1 else (9 if mono else 17)
    bound = 4 * (1 + (b[3] >> 4 & 3)) if b[3] >> 6 == 1 else 32
    return Header(mpeg1, layer, not b[1] & 1, kbits, hz, padding, mono, samples, size, side if layer == 3 else 0, bound)


def _layer2(h: Header) -> tuple[int, ...]:
    """Bits of each subband's allocation code."""
    rate = h.kbits // (1 if h.mono else 2)
    name = "low" if not h.mpeg1 else ("d" if h.hertz == 32000 else "c") if rate <= 48 else "b" if rate >= 96 and h.hertz != 48000 else "a"
    return tuple(bits for many, bits in LAYER2[name] for _ in range(many))


def checked_bits(h: Header, body: bytes) -> int | None:
    """How many bits after a protected frame's checksum it covers; None if the frame is too short to hold them.

    Layer III: the side information. Layer I: the allocation, 4 bits a subband and channel. Layer II: the allocation and
    2 bits of scale-factor selection for each subband and channel that has any samples.
    """
    channels = 1 if h.mono else 2
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        bits = 4 * sum(channels if k < h.bound else 1 for k in range(32))
    else:
        sizes, whole = _layer2(h), int.from_bytes(body[:64].ljust(64, b"\0"), "big")
        bits = used = 0
        for k, size in enumerate(sizes):
            own = channels if k < h.bound else 1
            for _ in range(own):
                some = whole >> (512 - bits - size) & (1 << size) - 1
                used += bool(some) * (channels if own == 1 else 1)
                bits += size
        bits += 2 * used
    return bits if bits <= 8 * len(body) else None


def verified(h: Header, frame: bytes) -> bool:
    """Whether a protected frame's checksum is that of its header's last two bytes and what checked_bits says."""
    body = frame[6:]
    bits = checked_bits(h, body)
    return bits is not None and crc16_bits(body, bits, crc16(frame[2:4])) == int.from_bytes(frame[4:6], "big")


@dataclass
class Stream:
    tags: dict[str, bytes] = field(default_factory=dict)
    kinds: list[str] = field(default_factory=list)  # the tags met: ID3v2, ID3v1, APE, Xing, Info, VBRI
    frames: list[tuple[int, Header]] = field(default_factory=list)  # audio frames with their offsets
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    delay: int = 0
    filler: int = 0
    skipped: int = 0  # bytes between frames that belong to nothing
    checked: int = 0
    wrong: int = 0  # frames whose checksum differs

    @property
    def samples(self) -> int:
        return max(0, sum(h.samples for _, h in self.frames) - self.delay - self.filler)

    @property
    def hertz(self) -> int:
        return self.frames[0][1].hertz if self.frames else 0

    def offsets(self, every_ms: int = 1000) -> list[int]:
        """Where to begin to read for each multiple of every_ms."""
        if not self.frames:
            return []
        begins = np.cumsum([0, *(h.samples for _, h in self.frames[:-1])])
        at = np.arange(0, int(begins[-1]) + 1, max(1, self.hertz * every_ms // 1000))
        return [self.frames[k][0] for k in np.searchsorted(begins, at, "right") - 1]


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(s: Stream, data: bytes) -> int:
    """Length of the tag at the start, and its frames' contents (versions 3 and 4)."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    end = 10 + _syncsafe(data[6:10])
    s.kinds.append("ID3v2")
    at = 10
    while at + 10 <= min(end, len(data)) and data[at] and data[3] in (3, 4):
        n = _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if n <= 0 or at + 10 + n > end:
            break
        s.tags[data[at : at + 4].decode("latin-1")] = data[at + 10 : at + 10 + n]
        at += 10 + n
    return end + 10 * bool(data[5] & 16)


def _vbr(s: Stream, data: bytes, at: int, h: Header) -> bool:
    """Whether the frame is a variable-bit-rate table rather than audio; reads it."""
    body = at + 4 + h.side + 2 * h.protected
    for mark, skip in ((data[body : body + 4], body), (data[at + 4 + h.side : at + 8 + h.side], at + 4 + h.side)):
        if mark in (b"Xing", b"Info"):
            s.kinds.append(mark.decode())
            flags, p = int.from_bytes(data[skip + 4 : skip + 8], "big"), skip + 8
            if flags & 1:
                s.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                s.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                s.toc, p = data[p : p + 100], p + 100
            p += 4 * bool(flags & 8)
            lame = data[p : p + 24]
            if len(lame) == 24 and p + 24 <= at + h.size and lame[:4].isalpha():
                s.delay, s.filler = lame[21] << 4 | lame[22] >> 4, (lame[22] & 15) << 8 | lame[23]
            return True
    if data[at + 36 : at + 40] == b"VBRI":
        s.kinds.append("VBRI")
        s.vbr_bytes, s.vbr_frames = int.from_bytes(data[at + 46 : at + 50], "big"), int.from_bytes(data[at + 50 : at + 54], "big")
        return True
    return False


def parse(data: bytes) -> Stream:
    """All frames and tags of an MPEG audio stream.

    A header counts if the next frame, of the same kind, follows where it ends (or the data end there, or a tag begins);
    else the search for one goes on a byte later, so junk between frames is skipped and a cut last frame is left out.
    """
    s, end = Stream(), len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        s.kinds.append("ID3v1")
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = int.from_bytes(data[end - 20 : end - 16], "little"), int.from_bytes(data[end - 12 : end - 8], "little")
        if 32 <= size <= end:
            s.kinds.append("APE")
            end -= size + 32 * bool(flags >> 31)
    at = min(end, _id3v2(s, data))
    kind, first = None, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and (kind is None or h.kind == kind) and at + h.size <= end:
            nxt = at + h.size
            follow = header(data[nxt : nxt + 4]) if nxt + 4 <= end else None
            if nxt == end or (follow and follow.kind == h.kind) or (kind is not None and nxt + 4 > end):
                if h.protected:
                    s.checked += 1
                    s.wrong += not verified(h, data[at:nxt])
                if not (first and h.layer == 3 and _vbr(s, data, at, h)):
                    s.frames.append((at, h))
                kind, first, at = h.kind, False, nxt
                continue
            if kind is not None and s.frames:
                # The last frame before junk: its own place is certain, since the one before led here.
                led = s.frames[-1][0] + s.frames[-1][1].size == at
                if led:
                    s.frames.append((at, h))
                    s.checked += h.protected
                    s.wrong += h.protected and not verified(h, data[at:nxt])
                    at = nxt
                    continue
        found = data.find(b"\xff", at + 1, end)
        found = end if found < 0 else found
        s.skipped += found - at
        at = found
    s.skipped += max(0, end - at)
    return s


def _frame_head(rate: int, padding: int) -> bytes:
    two = bytes([rate << 4 | 2 << 2 | padding << 1, 3 << 6])
    side = bytes(STORED_SIDE)
    return b"\xff\xfa" + two + crc16(two + side).to_bytes(2, "big") + side


_SIZES = [1152 // 8 * k * 1000 // STORED_HERTZ for k in STORED_KBITS]
_HEADS = {(r, 0): _frame_head(r, 0) for r in range(1, 15)}
_BODY = 4 + 2 + STORED_SIDE
#: Zero bytes at least at the end of a stored file: as many as the longest tag that is looked for there.
_QUIET = 128


def store(payload: bytes) -> bytes:
    """An MPEG audio file that holds the payload: an ID3v2 tag with its length, a Xing table, and its frames.

    The last frame ends with _QUIET zero bytes at least, so no payload stands where parse() looks for a tag's mark.
    """
    note = b"\x00payload\x00" + str(len(payload)).encode()
    tag = b"TXXX" + len(note).to_bytes(4, "big") + b"\x00\x00" + note
    room = _SIZES[14] - _BODY
    frames = []
    parts = [payload[at : at + room] for at in range(0, len(payload), room)]
    if not parts or len(parts[-1]) + _QUIET > room:
        parts.append(b"")
    for k, part in enumerate(parts):
        least = len(part) + _QUIET * (k + 1 == len(parts))
        rate = next(r for r in range(1, 15) if _SIZES[r] - _BODY >= least)
        frames.append(_HEADS[rate, 0] + part + bytes(_SIZES[rate] - _BODY - len(part)))
    audio, table_size = b"".join(frames), _SIZES[6]
    ends = np.cumsum([len(f) for f in frames])
    place = np.concatenate([[0], ends])[np.arange(100) * len(frames) // 100] + table_size
    toc = np.minimum(255, place * 256 // (len(audio) + table_size)).astype(np.uint8).tobytes()
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + (len(audio) + table_size).to_bytes(4, "big") + toc
    head = _HEADS[6, 0] + xing
    return b"ID3\x03\x00\x00" + bytes([len(tag) >> s & 127 for s in (21, 14, 7, 0)]) + tag + head + bytes(table_size - len(head)) + audio


def load(media: bytes, s: Stream | None = None) -> bytes:
    """The payload that store() put into a file; an error if less than its noted length is there."""
    s = s or parse(media)
    n = int(s.tags["TXXX"].split(b"\x00")[2])
    back = b"".join(media[at + _BODY : at + h.size] for at, h in s.frames)[:n]
    if len(back) != n:
        raise ValueError(f"{len(back)} of {n} payload bytes are there")
    return back


def describe(s: Stream) -> str:
    """Exact duration as samples over samples a second, frames, checksums, tags, and a digest of the frame seek offsets."""
    offsets = np.array([at for at, _ in s.frames], np.int64)
    return f"samples={s.samples}/{s.hertz};frames={len(s.frames)};crc={s.checked - s.wrong}/{s.checked};skipped={s.skipped};tags={'+'.join(s.kinds)};seek={zlib.crc32(offsets.tobytes()):08x}"


def inspect(files: DataFrame, media: str = "media", every_ms: int = 1000) -> DataFrame:
    """files with the facts of each MPEG audio file in the binary column `media`.

    Adds samples, hertz, duration_s, frames, frames_checked, frames_wrong, skipped_bytes, tags, frame_offsets (of every
    frame) and seek_offsets (one for each every_ms). Checksums of all three layers are verified (see checked_bits). Defined
    results: null and empty media, and media without a frame, have 0 frames and no duration; existing columns of those names
    are replaced; rows that repeat are alike; an empty table gives an empty table.
    """
    new = [("samples", "long"), ("hertz", "int"), ("duration_s", "double"), ("frames", "long"), ("frames_checked", "long"), ("frames_wrong", "long"), ("skipped_bytes", "long"), ("tags", "array<string>"), ("frame_offsets", "array<bigint>"), ("seek_offsets", "array<bigint>")]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    rest = [c for c in files.columns if c not in dict(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in texts_of(batch, media):
                s = parse(x or b"")
                out.append((s.samples, s.hertz, s.samples / s.hertz if s.hertz else None, len(s.frames), s.checked, s.wrong, s.skipped, s.kinds, [at for at, _ in s.frames], s.offsets(every_ms)))
            if out:
                yield pa.record_batch([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=[*batch.schema.names, *dict(new)])

    given = files.select(*rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(run, schema + "".join(f", {k} {t}" for k, t in new))


def digest(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Each text as an MPEG audio file, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (see describe), and with_media the file itself.

    Defined results: a null text is empty; an empty text's payload is 64 zero bytes. A null doc_id is kept. Rows that repeat
    are alike. Very long texts are stored whole, in as many frames as they take. Bytes that are no UTF-8 are stored as they
    are. Other columns, whatever their names, are not returned. An empty table gives an empty table.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())] + [("media", pa.binary())] * with_media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in texts_of(batch):
                text = text or b""
                media = store(text + bytes(-len(text) % 64 if text else 64))
                s = parse(media)
                back = load(media, s)
                row = len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(s)
                out.append((*row, media) if with_media else row)
            if out:
                yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media)


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
