"""Signature sniffing of media columns, and lossless sample containers for texts.

An Aho-Corasick automaton finds magic bytes and end marks in each value, in one pass; a validator per
format confirms structure and lengths at each place. A valid object at the start decides the type,
whatever was declared; valid objects further on, outside one another, are carved. Validators follow
the length fields of a format and never trust them beyond the value's end. Those that walk from block
to block share what they have walked: where walks have failed, the chain of blocks that WAV objects follow,
and the checksums of long PNG blocks, which come from those of the value's beginnings. So a value full of magic
bytes is still walked about once.

Defined results: null values have a null type and nothing carved; empty and unknown ones the type
'application/octet-stream' unless the declared type has no validator here, which is then kept; a value
cut off inside its object is not that type; equal and repeated rows give equal results, each its own;
very long values are read whole; an empty table gives no rows; columns of an input keep their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, text_slices

UNKNOWN = "application/octet-stream"


class Value:
    """What validators share about one value, so that together they walk it about once: where end marks
    stand, and from which places a walk is known to fail."""

    def __init__(self) -> None:
        self.ends: dict[bytes, list[int]] = {mark: [] for mark in ENDS}
        self.dead: set[tuple] = set()
        self.chain: dict[int, tuple[int, int, int, int, int]] = {}
        self.begun: list[int] = []

    def next(self, mark: bytes, at: int) -> int:
        places = self.ends[mark]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def alive(self, state: tuple, way: list[tuple]) -> bool:
        way.append(state)
        return state not in self.dead

    def failed(self, way: list[tuple]) -> None:
        self.dead.update(way)

    def checksum(self, b: bytes, at: int, to: int) -> int:
        """crc32 of b[at:to]; that of a long piece is what b[:to]'s holds beyond b[:at]'s."""
        if to - at <= STEP:
            return zlib.crc32(b[at:to])
        return self._before(b, to) ^ _moved(self._before(b, at), to - at)

    def _before(self, b: bytes, to: int) -> int:
        """crc32 of b[:to]."""
        while len(self.begun) <= to // STEP:
            n = len(self.begun)
            self.begun.append(zlib.crc32(b[(n - 1) * STEP : n * STEP], self.begun[-1]) if n else 0)
        return zlib.crc32(b[to // STEP * STEP : to], self.begun[to // STEP])

    def blocks(self, b: bytes, at: int) -> None:
        """Enter the chain of RIFF blocks from ``at`` on: for each the next one, one further on whose
        distance makes any search along the chain logarithmic, its depth from the end, and how many 'fmt '
        and 'data' blocks lie from it to the end."""
        new = []
        while at not in self.chain:
            new.append(at)
            if at + 8 > len(b):
                break
            n = struct.unpack_from("<I", b, at + 4)[0]
            at += 8 + n + n % 2
        for here in reversed(new):
            if here + 8 > len(b):
                self.chain[here] = (here, here, 0, 0, 0)
                continue
            n = struct.unpack_from("<I", b, here + 4)[0]
            after = here + 8 + n + n % 2
            _, far, depth, formats, data = self.chain[after]
            beyond = self.chain[far]
            # equal jumps before merge into one of twice the length
            jump = beyond[1] if depth - beyond[2] == beyond[2] - self.chain[beyond[1]][2] else after
            kind = b[here : here + 4]
            self.chain[here] = (after, jump, depth + 1, formats + (kind == b"fmt "), data + (kind == b"data"))

    def leads(self, at: int, end: int) -> bool:
        """Whether blocks from ``at`` on end exactly at ``end`` and hold both a 'fmt ' and a 'data' one."""
        here = at
        while here < end:
            after, jump, depth, _, _ = self.chain[here]
            if not depth:
                return False
            here = jump if jump <= end else after
        if here != end:
            return False
        first, last = self.chain[at], self.chain[end]
        return first[3] > last[3] and first[4] > last[4]


#: Bytes between the places whose checksums are kept; shorter pieces are read anew.
STEP = 4096
_POLYNOMIAL = 0xEDB88320


def _product(a: int, b: int) -> int:
    """Of two polynomials over GF(2), modulo that of crc32, whose highest coefficients are the lowest bits."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ _POLYNOMIAL if b & 1 else b >> 1
    return out


@lru_cache(maxsize=64)
def _square(i: int) -> int:
    """x ** (2 ** i)."""
    return 1 << 30 if i == 0 else _product(_square(i - 1), _square(i - 1))


def _moved(crc: int, n: int) -> int:
    """A checksum's part in that of a text that goes on for ``n`` bytes."""
    out, i = crc, 3
    while n:
        if n & 1:
            out = _product(_square(i), out)
        n, i = n >> 1, i + 1
    return out


def _wav(b: bytes, at: int, value: Value) -> int | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    value.blocks(b, at + 12)
    return end if value.leads(at + 12, end) else None


def _png(b: bytes, at: int, value: Value) -> int | None:
    here, way = at + 8, []
    if b[here + 4 : here + 8] != b"IHDR":
        return None
    while here + 12 <= len(b) and value.alive(("png", here), way):  # lengths first, which cost nothing
        here += 12 + struct.unpack_from(">I", b, here)[0]
        if here <= len(b) and b[(last := way[-1][1]) + 4 : last + 8] == b"IEND":
            break
    else:
        return value.failed(way)
    for i, ((_, start), end) in enumerate(zip(way, [*(x for _, x in way[1:]), here])):
        if value.checksum(b, start + 4, end - 4) != struct.unpack_from(">I", b, end - 4)[0]:
            return value.failed(way[: i + 1])  # what follows may be part of another object
    return here


def _bmp(b: bytes, at: int, value: Value) -> int | None:
    if len(b) < at + 54:
        return None
    size, _, begin, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    fits = header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and begin >= 14 + header and begin + row * abs(height) <= size
    return at + size if fits and at + size <= len(b) else None


def _gif(b: bytes, at: int, value: Value) -> int | None:
    here, way = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10 : at + 11] and b[at + 10] & 128 else 0), []
    try:
        while value.alive(("gif", here), way):
            if b[here] == 0x3B:
                return here + 1
            if b[here] == 0x2C:
                here += 11 + (3 << ((b[here + 9] & 7) + 1) if b[here + 9] & 128 else 0)
            elif b[here] == 0x21:
                here += 2
            else:
                break
            while b[here]:
                here += 1 + b[here]
            here += 1
    except IndexError:
        pass
    return value.failed(way)


def _jpeg(b: bytes, at: int, value: Value) -> int | None:
    here, scan, way = at + 2, False, []
    while (here + 4 <= len(b) or b[here : here + 2] == b"\xff\xd9") and value.alive(("jpeg", here, scan), way):
        kind = b[here + 1]
        if b[here] != 0xFF or kind < 0xC0 or kind == 0xFF:
            break
        if kind == 0xD9:
            if scan:
                return here + 2
            break
        here += 2 + struct.unpack_from(">H", b, here + 2)[0]
        if kind == 0xDA:
            scan = True
            here = b.find(b"\xff", here)
            while 0 <= here < len(b) - 1 and (b[here + 1] == 0 or 0xD0 <= b[here + 1] <= 0xD7):
                here = b.find(b"\xff", here + 2)
            if not 0 <= here < len(b) - 1:
                break
    return value.failed(way)


def _pdf(b: bytes, at: int, value: Value) -> int | None:
    end = value.next(b"%%EOF", at) if b[at + 5 : at + 6].isdigit() else -1
    return end + 5 if end >= 0 else None


def _zip(b: bytes, at: int, value: Value) -> int | None:
    end = value.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, begin, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note if at + begin + size == end and end + 22 + note <= len(b) else None


def _ogg(b: bytes, at: int, value: Value) -> int | None:
    here, way = at, []
    while b[here : here + 5] == b"OggS\0" and here + 27 <= len(b) and value.alive(("ogg", here), way):
        n, last = b[here + 26], b[here + 5] & 4
        here += 27 + n + sum(b[here + 27 : here + 27 + n])
        if last and here <= len(b):
            return here
    return value.failed(way)


def _au(b: bytes, at: int, value: Value) -> int | None:
    if len(b) < at + 24:
        return None
    begin, size, kind, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    return at + begin + size if begin >= 24 and 1 <= kind <= 27 and rate and channels and at + begin + size <= len(b) else None


#: Magic bytes, media type and validator of each format.
FORMATS: dict[bytes, tuple[str, Callable[[bytes, int, Value], int | None]]] = {
    b"RIFF": ("audio/wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"BM": ("image/bmp", _bmp),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"%PDF-": ("application/pdf", _pdf),
    b"PK\x03\x04": ("application/zip", _zip),
    b"OggS": ("audio/ogg", _ogg),
    b".snd": ("audio/basic", _au),
}
#: Marks that end an object, found in the same pass.
ENDS = (b"%%EOF", b"PK\x05\x06")
_KNOWN = {t for t, _ in FORMATS.values()}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in (*FORMATS, *ENDS):
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the outermost valid objects, in order."""
    about, starts = Value(), []
    for last, magic in _automaton().iter(value.decode("latin-1")):
        at = last + 1 - len(magic)
        if magic in ENDS:
            about.ends[magic].append(at)
        else:
            starts.append((at, magic))
    found, free = [], 0
    for at, magic in starts:
        if at >= free and (end := FORMATS[magic][1](value, at, about)) is not None:
            found.append((FORMATS[magic][0], at, end - at))
            free = end
    return found


def verdict(value: bytes, declared: str | None) -> tuple[str, bool, list[tuple[str, int, int]]]:
    """(type, whether it corrects the declared one, what is embedded)."""
    objects = sniff(value)
    whole = bool(objects) and objects[0][1] == 0
    kind = objects[0][0] if whole else declared if declared and declared not in _KNOWN else UNKNOWN
    return kind, declared is not None and kind != declared, objects[whole:]


_CARVED = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))
FOUND = ("detected_type", "corrected", "embedded")


def correct(media: DataFrame, column: str = "content", declared: str = "media_type") -> DataFrame:
    """``media`` with detected_type, corrected and embedded (type, offset, length and bytes of each carved
    object). Where ``media`` has columns of these names, the new ones get underscores in front."""
    ship(media.sparkSession)
    own = media.columns
    names = [fresh(media, c) for c in FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                kinds, changes, carved = [], [], []
                for value, said in zip(batch.column(own.index(column)), batch.column(own.index(declared)).to_pylist()):
                    value = value.as_py()
                    kind, changed, inner = (None, False, []) if value is None else verdict(value, said)
                    kinds.append(kind)
                    changes.append(changed)
                    carved.append([{"type": t, "offset": a, "length": n, "content": value[a : a + n]} for t, a, n in inner])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(changes, pa.bool_()), pa.array(carved, _CARVED)], [*own, *names])

    types = ", ".join(f"`{c}` {t}" for c, t in media.dtypes)
    kinds = ("string", "boolean", "array<struct<type:string,offset:long,length:long,content:binary>>")
    return media.mapInArrow(run, types + "".join(f", `{c}` {t}" for c, t in zip(names, kinds)))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples in a RIFF container; the payload's length is even."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(stored: bytes) -> bytes:
    here = 12
    while stored[here : here + 4] != b"data":
        n = struct.unpack_from("<I", stored, here + 4)[0]
        here += 8 + n + n % 2
    return stored[here + 8 : here + 8 + struct.unpack_from("<I", stored, here + 4)[0]]


def to_au(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples, of the linear kind, under a header of 24 bytes."""
    return b".snd" + struct.pack(">IIIII", 24, len(payload), 2, rate, 1) + payload


def from_au(stored: bytes) -> bytes:
    begin, size = struct.unpack_from(">II", stored, 4)
    return stored[begin : begin + size]


#: Writer and reader of each type that texts are stored as.
STORED = {"audio/wav": (to_wav, from_wav), "audio/basic": (to_au, from_au)}


def store_texts(docs: DataFrame, unit: int = 64) -> DataFrame:
    """Every text as a media value: (doc_id, n_bytes, media_type, content binary). The checksum of the
    padded text chooses the container and what is declared: its type, the other one's, that of an
    image, or nothing; so equal texts have equal values and most declarations are wrong."""
    ship(docs.sparkSession)
    kinds = list(STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            sizes, said, media = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                payload = data[a:b].tobytes() + bytes(max(1, -(-(b - a) // unit)) * unit - (b - a))
                mark = zlib.crc32(payload)
                sizes.append(b - a)
                said.append((*kinds, "image/png", None)[mark // 2 % 4])
                media.append(STORED[kinds[mark % 2]][0](payload))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(said, pa.string()), pa.array(media, pa.large_binary())], ["doc_id", "n_bytes", "media_type", "content"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media_type string, content binary")


def features(corrected: DataFrame) -> DataFrame:
    """What the values of ``store_texts`` hold, read back by the type that ``correct`` found."""
    ship(corrected.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, media, kind, changed in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "content", "detected_type", "corrected"))):
                value, kind = media.as_py(), kind.as_py()
                payload = STORED[kind][1](value)
                inside = sniff(payload)
                level = int(np.frombuffer(payload, np.uint8).sum()) // len(payload)
                feature = f"type={kind};corrected={int(changed.as_py())};samples={len(payload)};mean={level};embedded={','.join(f'{t}@{a}+{m}' for t, a, m in inside)}"
                rows.append((doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(value), hashlib.sha256(value).hexdigest(), feature))
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return corrected.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
