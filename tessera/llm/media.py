"""Media columns: type sniffing by magic bytes with structural checks, and carving of embedded media."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import as_bytes, map_texts, prepare

#: Magic bytes, where they stand in their file, and the type they announce (fixed values).
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"), (b"GIF87a", 0, "image/gif"), (b"GIF89a", 0, "image/gif"), (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"RIFF", 0, "riff"), (b"BM", 0, "image/bmp"), (b"II*\x00", 0, "image/tiff"), (b"MM\x00*", 0, "image/tiff"), (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"), (b"\x1f\x8b\x08", 0, "application/gzip"), (b"OggS", 0, "audio/ogg"), (b"fLaC", 0, "audio/flac"),
    (b"ftyp", 4, "video/mp4"), (b"\x1aE\xdf\xa3", 0, "video/x-matroska"), (b"P5\n", 0, "image/x-portable-graymap"), (b"P6\n", 0, "image/x-portable-pixmap"),
]
UNKNOWN = "application/octet-stream"


class Media(NamedTuple):
    type: str
    start: int
    length: int


class Look:
    """What several checks of one blob share, so that each place is searched once: the next places of patterns, and ends of chains."""

    def __init__(self, b: bytes):
        self.b = b
        self.known: dict[bytes, tuple[int, int]] = {}
        self.ends: dict[str, dict[int, int]] = {"mp4": {}, "ogg": {}, "gif": {}, "gif data": {}}
        self.streams: dict[int, tuple[int, int, int]] = {}
        self._pdf_ends: tuple | None = None

    def next(self, pattern: bytes, at: int) -> int:
        """The first place of a pattern from ``at`` on, -1 without any."""
        since, found = self.known.get(pattern, (0, -2))
        if found == -2 or not since <= at or 0 <= found < at:
            found = self.b.find(pattern, at)
            self.known[pattern] = at, found
        return found

    def pdf_ends(self):
        """Starts, ends and stated places of all cross-reference ends, and the largest place and way back of each one and all after it."""
        if self._pdf_ends is None:
            found = [(m.start(), m.end(), min(int(m[1][-18:]), 1 << 60)) for m in PDF_END.finditer(self.b)]
            starts, ends, places = (np.array([x[i] for x in found], dtype=np.int64) for i in range(3))
            largest = lambda x: np.maximum.accumulate(x[::-1])[::-1] if len(x) else x
            self._pdf_ends = starts, ends, places, largest(places), largest(starts - places)
        return self._pdf_ends

    def inflated(self, at: int) -> tuple[int, int, int]:
        """(end, check number, size) of the deflate stream at a place, end 0 if there is none."""
        if at not in self.streams:
            reader, view = zlib.decompressobj(-15), memoryview(self.b)
            pos, crc, size = at, 0, 0
            try:
                while pos < len(self.b) and not reader.eof:
                    data = view[pos : pos + (1 << 16)]
                    pos += len(data)
                    while data:
                        out = reader.decompress(data, 1 << 20)
                        crc, size = zlib.crc32(out, crc), size + len(out)
                        data = reader.unconsumed_tail
            except zlib.error:
                pass
            self.streams[at] = (pos - len(reader.unused_data), crc, size) if reader.eof else (0, 0, 0)
        return self.streams[at]

    def chain(self, kind: str, at: int, step) -> int:
        """The end of the chain of parts that starts at a place; ``step`` gives the end of one part, or its own start."""
        ends, seen, pos = self.ends[kind], [], at
        while pos not in ends and (end := step(pos)) > pos:
            seen.append(pos)
            pos = end
        end = ends.get(pos, pos)
        ends.update(dict.fromkeys(seen, end))
        return end


def _png(b: bytes, at: int, look: Look) -> int:
    pos = at + 8
    first = True
    while pos + 12 <= len(b):
        size, kind = struct.unpack(">I4s", b[pos : pos + 8])
        if pos + 12 + size > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack(">I", b[pos + 8 + size : pos + 12 + size])[0]:
            return 0
        pos, first = pos + 12 + size, False
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(b: bytes, at: int, look: Look) -> int:
    """A header, and blocks up to the trailer; ends of blocks and of their data are remembered for all places of the blob."""

    def data(pos: int) -> int:
        return pos + 1 + b[pos] if pos < len(b) and b[pos] else pos

    def block(pos: int) -> int:
        kind = b[pos] if pos < len(b) else 0
        if kind == 0x21:
            start = pos + 2
        elif kind == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            start = pos + 11 + (3 << ((local & 7) + 1) if local & 128 else 0)
        else:
            return pos
        return look.chain("gif data", start, data) + 1

    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    end = look.chain("gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0), block)
    return end + 1 - at if end < len(b) and b[end] == 0x3B else 0


def _jpeg(b: bytes, at: int, look: Look) -> int:
    pos = at + 2
    while pos + 2 <= len(b):
        if b[pos] != 0xFF:
            return 0
        kind = b[pos + 1]
        if kind == 0xD9:
            return pos + 2 - at
        if pos + 4 > len(b):
            return 0
        size = struct.unpack(">H", b[pos + 2 : pos + 4])[0]
        if size < 2:
            return 0
        pos += 2 + size
        if kind == 0xDA:
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return 0
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
    return 0


def _riff(b: bytes, at: int, look: Look) -> int:
    if at + 12 > len(b):
        return 0
    size = struct.unpack("<I", b[at + 4 : at + 8])[0]
    if b[at + 8 : at + 12] not in RIFF_TYPES or size < 4 or at + 8 + size > len(b):
        return 0
    pos, end = at + 12, at + 8 + size
    while pos + 8 <= end:
        pos += 8 + (n := struct.unpack("<I", b[pos + 4 : pos + 8])[0]) + n % 2
    return end - at if pos in (end, end + 1) else 0


def _bmp(b: bytes, at: int, look: Look) -> int:
    if at + 54 > len(b):
        return 0
    size, reserved, offset, header = struct.unpack("<IIII", b[at + 2 : at + 18])
    return size if not reserved and header in (12, 40, 52, 56, 64, 108, 124) and 26 <= offset <= size <= len(b) - at else 0


#: Bytes of a value by its TIFF type, tags that hold places of further IFDs, and pairs of tags for places and sizes of data (fixed values).
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
TIFF_IFDS = (330, 400, 34665, 34853, 40965)
TIFF_DATA = ((273, 279), (324, 325), (513, 514), (288, 289))


def _tiff(b: bytes, at: int, look: Look) -> int:
    """The furthest end of any IFD, value, strip or tile, over all IFDs."""
    order = "<" if b[at : at + 2] == b"II" else ">"
    if at + 8 > len(b):
        return 0
    todo, done, upto = [struct.unpack(order + "I", b[at + 4 : at + 8])[0]], set(), 8
    while todo:
        entry = todo.pop()
        if entry in done:
            continue
        done.add(entry)
        if entry < 8 or at + entry + 2 > len(b):
            return 0
        n = struct.unpack(order + "H", b[at + entry : at + entry + 2])[0]
        end = entry + 6 + 12 * n
        if not n or at + end > len(b):
            return 0
        upto, tags = max(upto, end), {}
        for pos in range(at + entry + 2, at + end - 4, 12):
            tag, kind, count = struct.unpack(order + "HHI", b[pos : pos + 8])
            size = TIFF_SIZES.get(kind, 0) * count
            place = pos + 8
            if size > 4:
                place = at + struct.unpack(order + "I", b[pos + 8 : pos + 12])[0]
                upto = max(upto, place + size - at)
                if place + size > len(b):
                    return 0
            if kind in (3, 4, 13) and count:
                tags[tag] = struct.unpack(f"{order}{count}{'H' if kind == 3 else 'I'}", b[place : place + size])
        for tag in TIFF_IFDS:
            todo += tags.get(tag, ())
        for places, sizes in TIFF_DATA:
            known = tags.get(sizes, ())
            if places == 273 and not known and 273 in tags:  # old files of one uncompressed strip leave its size out
                wide, high, each = (tags.get(t, (d,)) for t, d in ((256, 0), (257, 0), (277, 1)))
                bits = tags.get(258, (1,))
                known = (high[0] * -(-wide[0] * (sum(bits) if len(bits) > 1 else bits[0] * each[0]) // 8),)
            upto = max([upto, *(p + n for p, n in zip(tags.get(places, ()), known))])
        following = struct.unpack(order + "I", b[at + end - 4 : at + end])[0]
        todo += [following] if following else []
    return upto if at + upto <= len(b) else 0


LINEARIZED = re.compile(rb"/Linearized\b")
PDF_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
XREF = re.compile(rb"\s*(?:xref\b|\d+\s+\d+\s+obj\b)")


def _pdf(b: bytes, at: int, look: Look) -> int:
    """The stated length of a linearised file, if an end stands there; else up to the last section that belongs to it.

    A later section belongs if no other header stands before its end, or if its cross-references are where it says, counted
    from this file's start, and after the section before.
    """
    first = look.next(b"%%EOF", at)
    if first < 0 or not 0 <= look.next(b"startxref", at) < first:
        return 0
    upto = first + 5
    head = b[at : at + 1024]
    stated = re.search(rb"/L\s+(\d{1,15})", head) if LINEARIZED.search(head) else None
    if stated and at + int(stated[1]) >= upto and at + int(stated[1]) <= len(b) and b[at + int(stated[1]) - 16 : at + int(stated[1])].rstrip().endswith(b"%%EOF"):
        upto = at + int(stated[1])
    starts, ends, places, far, back = look.pdf_ends()
    i = int(np.searchsorted(starts, upto))
    while i < len(starts):
        header = look.next(b"%PDF-", upto)
        near = int(np.searchsorted(ends, header if header >= 0 else len(b), side="right"))
        if near <= i:  # another header stands before the next end
            near = 0
            if at + far[i] >= upto and back[i] > at:  # else no later end points into this file
                pointing = i + np.flatnonzero((at + places[i:] >= upto) & (at + places[i:] < starts[i:]))
                near = next((int(k) + 1 for k in pointing if XREF.match(b, at + int(places[k]))), 0)
        if not near:
            break
        upto, i = int(ends[near - 1]), near
    return upto - at


def _zip(b: bytes, at: int, look: Look) -> int:
    end = look.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, note = struct.unpack("<IIH", b[end + 12 : end + 22])
    return end + 22 + note - at if at + offset + size == end and end + 22 + note <= len(b) else 0


def _gzip(b: bytes, at: int, look: Look) -> int:
    """A header, its fields as flagged, a deflate stream, and its check number and size."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    flags, pos = b[at + 3], at + 10
    if flags & 4:
        pos += 2 + int.from_bytes(b[pos : pos + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            pos = look.next(b"\0", pos) + 1
            if not pos:
                return 0
    pos += flags & 2
    end, crc, size = look.inflated(pos)
    return end + 8 - at if end and b[end : end + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else 0


def _ogg(b: bytes, at: int, look: Look) -> int:
    def page(pos: int) -> int:
        if b[pos : pos + 5] != b"OggS\x00" or pos + 27 > len(b):
            return pos
        n = b[pos + 26]
        return pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])

    end = look.chain("ogg", at, page)
    return end - at if end <= len(b) else 0


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> (bits - 1) else 0)) & ((1 << bits) - 1)
        out.append(x)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


class _Bits:
    """Reads bits from the highest on; IndexError past the end."""

    def __init__(self, b: bytes, at: int):
        self.b, self.pos = b, at * 8

    def skip(self, n: int) -> None:
        self.pos += n
        if self.pos > 8 * len(self.b):
            raise IndexError

    def read(self, n: int) -> int:
        start = self.pos
        self.skip(n)
        last = (self.pos + 7) // 8
        return int.from_bytes(self.b[start // 8 : last], "big") >> (8 * last - self.pos) & ((1 << n) - 1)

    def zeros(self) -> int:
        """The number of zeros up to the next one, which is read too."""
        start, byte, left = self.pos, self.pos // 8, 8 - self.pos % 8
        part = self.b[byte] & ((1 << left) - 1)
        while not part:
            byte, left = byte + 1, 8
            part = self.b[byte]
        self.pos = byte * 8 + 9 - part.bit_length()
        return self.pos - 1 - start


def _residual(bits: _Bits, block: int, order: int) -> None:
    method, parts = bits.read(2), bits.read(4)
    if method > 1 or block % (1 << parts) or block >> parts < order:
        raise ValueError
    wide = 4 + method
    for i in range(1 << parts):
        n = (block >> parts) - (order if i == 0 else 0)
        k = bits.read(wide)
        if k == (1 << wide) - 1:
            bits.skip(n * bits.read(5))
        else:
            for _ in range(n):
                bits.zeros()
                bits.skip(k)


def _flac_frame(b: bytes, pos: int, depth: int) -> tuple[int, int]:
    """(end, samples) of the frame at a place, read through as its coding says; ValueError or IndexError if it is none."""
    bits = _Bits(b, pos)
    if bits.read(15) != 0x7FFC:
        raise ValueError
    bits.skip(1)
    size, rate, channels, wide = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    if bits.read(1) or not size or rate == 15 or channels > 10 or wide == 3:
        raise ValueError
    lead = bits.read(8)
    more = 0 if lead < 128 else 7 - (lead ^ 255).bit_length() if 192 <= lead < 255 else -1
    if more < 0:
        raise ValueError
    bits.skip(8 * more)
    block = 192 if size == 1 else 144 << size if size < 6 else bits.read(8) + 1 if size == 6 else bits.read(16) + 1 if size == 7 else 1 << size
    bits.skip({12: 8, 13: 16, 14: 16}.get(rate, 0))
    check = 0
    for x in b[pos : bits.pos // 8]:
        check = _CRC8[check ^ x]
    if check != bits.read(8):
        raise ValueError
    depth = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(wide, depth)
    for c in range(channels + 1 if channels < 8 else 2):
        each = depth + (c == 1 and channels in (8, 10) or c == 0 and channels == 9)
        if bits.read(1):
            raise ValueError
        kind = bits.read(6)
        each -= bits.zeros() + 1 if bits.read(1) else 0
        if each <= 0:
            raise ValueError
        if kind < 2:
            bits.skip(each * (block if kind else 1))
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            bits.skip(each * order)
            if kind >= 32:
                precision = bits.read(4) + 1
                if precision == 16:
                    raise ValueError
                bits.skip(5 + precision * order)
            _residual(bits, block, order)
        else:
            raise ValueError
    end = (bits.pos + 7) // 8 + 2
    check = 0
    for x in b[pos:end]:
        check = (check << 8 & 0xFFFF) ^ _CRC16[check >> 8 ^ x]
    if end > len(b) or check:
        raise ValueError
    return end, block


def _flac(b: bytes, at: int, look: Look) -> int:
    """Metadata blocks, then frames up to the stated number of samples, or as long as they check out if none is stated."""
    if at + 42 > len(b) or b[at + 4] & 127 or b[at + 5 : at + 8] != b"\x00\x00\x22":
        return 0
    told = int.from_bytes(b[at + 18 : at + 26], "big")
    depth, total = (told >> 36 & 31) + 1, told & ((1 << 36) - 1)
    pos, last = at + 4, False
    while not last:
        if pos + 4 > len(b):
            return 0
        last, pos = b[pos] >= 128, pos + 4 + int.from_bytes(b[pos + 1 : pos + 4], "big")
    samples = 0
    while pos < len(b) and (not total or samples < total):
        try:
            pos, n = _flac_frame(b, pos, depth)
        except (ValueError, IndexError):
            break
        samples += n
    return pos - at if pos <= len(b) and samples >= total else 0


def _mp4(b: bytes, at: int, look: Look) -> int:
    def box(pos: int) -> int:
        if pos + 8 > len(b):
            return pos
        size, kind = struct.unpack(">I4s", b[pos : pos + 8])
        if size == 1 and pos + 16 <= len(b):
            size = struct.unpack(">Q", b[pos + 8 : pos + 16])[0]
        return pos if size < 8 or pos + size > len(b) or not all(32 <= c < 127 for c in kind) else pos + size

    return look.chain("mp4", at, box) - at


SEGMENT = 0x18538067
#: What a segment and a cluster may hold (fixed values); of a cluster without a size, anything else ends it.
IN_SEGMENT = frozenset((0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367, 0xEC, 0xBF))
IN_CLUSTER = frozenset((0xE7, 0x5854, 0xA7, 0xAB, 0xA3, 0xA0, 0xAF, 0xEC, 0xBF))


def _element(b: bytes, pos: int) -> tuple[int, int, int | None]:
    """(id, where its data start, their size or None if it is not stated) of an EBML element; IndexError if there is none."""
    n = 9 - b[pos].bit_length()
    m = 9 - b[pos + n].bit_length()
    if n > 4 or m > 8 or pos + n + m > len(b):
        raise IndexError
    size = int.from_bytes(b[pos + n : pos + n + m], "big") & ((1 << 7 * m) - 1)
    return int.from_bytes(b[pos : pos + n], "big"), pos + n + m, None if size == (1 << 7 * m) - 1 else size


def _matroska(b: bytes, at: int, look: Look) -> int:
    """The header and its segments, by their sizes; a segment or cluster of unknown size goes on as long as its elements do."""
    pos, segments = at, 0
    try:
        _, data, size = _element(b, at)
        if size is None or data + size > len(b) or not any(b.find(x, data, data + min(size, 4096)) >= 0 for x in (b"matroska", b"webm")):
            return 0
        pos = data + size
        while True:
            kind, data, size = _element(b, pos)
            if kind != SEGMENT:
                break
            if size is not None:
                if data + size > len(b):
                    return 0
                pos, segments = data + size, segments + 1
                continue
            pos, segments = data, segments + 1
            inside = False
            while True:
                kind, data, size = _element(b, pos)
                if kind not in IN_SEGMENT and not (inside and kind in IN_CLUSTER) or size is None and kind != 0x1F43B675 or size is not None and data + size > len(b):
                    break
                inside = size is None or inside and kind in IN_CLUSTER
                pos = data if size is None else data + size
    except IndexError:
        pass
    return pos - at if segments else 0


def _pnm(b: bytes, at: int, look: Look) -> int:
    parts = b[at : at + 64].split(None, 4)
    try:
        wide, high, top = (int(x) for x in parts[1:4])
        head = len(parts[0]) + sum(len(x) for x in parts[1:4]) + 4
    except ValueError:
        return 0
    size = head + wide * high * (3 if parts[0] == b"P6" else 1) * (2 if top > 255 else 1)
    return size if wide > 0 and high > 0 and at + size <= len(b) else 0


RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
CHECKS = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "riff": _riff, "image/bmp": _bmp, "image/tiff": _tiff, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4, "video/x-matroska": _matroska,
    "image/x-portable-graymap": _pnm, "image/x-portable-pixmap": _pnm,
}


def magic_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for magic, offset, kind in MAGIC:
        automaton.add_word(magic.decode("latin-1"), (len(magic), offset, kind))
    automaton.make_automaton()
    return automaton


def find_media(blob: bytes, automaton, embedded: bool = True) -> list[Media]:
    """Media in a blob whose structure checks out, by place; none inside another unless ``embedded``.

    One scan locates magic bytes; a match counts if its format's structure and lengths hold.
    """
    out: list[Media] = []
    look = Look(blob)
    upto = 0
    for last, (n, offset, kind) in automaton.iter(blob.decode("latin-1")):
        at = last - n + 1 - offset
        if at < 0 or not embedded and at < upto:
            continue
        size = CHECKS[kind](blob, at, look)
        if size:
            out.append(Media(RIFF_TYPES.get(blob[at + 8 : at + 12], kind) if kind == "riff" else kind, at, size))
            upto = max(upto, at + size)
    return sorted(out, key=lambda m: (m.start, -m.length))


def sniff(blob: bytes | None, declared: str | None, automaton) -> tuple[str, bool, list[Media]]:
    """(type, whether it differs from the declared one, media found): the type of what starts the blob, else unknown."""
    found = find_media(blob, automaton) if blob else []
    kind = next((m.type for m in found if m.start == 0), UNKNOWN)
    return kind, kind != declared, found


PAD = 192
RATE = 8000


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes padded by spaces to a positive multiple of PAD, their number unpadded)."""
    raw = as_bytes(text)
    return raw + b" " * (-len(raw) % PAD or (0 if raw else PAD)), len(raw)


def to_wav(samples: bytes) -> bytes:
    """Samples as 8-bit mono PCM."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\x00" * (len(samples) % 2)


def from_wav(blob: bytes) -> bytes:
    """The samples of a WAV: its data chunk."""
    pos = 12
    while pos + 8 <= len(blob):
        kind, n = struct.unpack("<4sI", blob[pos : pos + 8])
        if kind == b"data":
            return blob[pos + 8 : pos + 8 + n]
        pos += 8 + n + n % 2
    return b""


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text's payload stored as 8-bit samples of a WAV, declared as unknown bytes."""

    def make():
        def fn(ids, texts):
            made = [payload_of(t) for t in texts]
            return ids, [n for _, n in made], [UNKNOWN] * len(ids), [to_wav(p) for p, _ in made]

        return fn

    prepare(docs.sparkSession)
    return map_texts(docs, "doc_id long, n_bytes long, declared string, media binary", make, ["doc_id", "text"])


def features(samples: bytes) -> str:
    """Mean, spread and zero crossings of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "n=0"
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    mean = int(x.sum()) / len(x)
    return f"n={len(x)};mean={mean:.4f};rms={math.sqrt(int((x * x).sum()) / len(x)):.4f};crossings={crossings}"


def inspect_media(rows: DataFrame, keep: list[str], media: str = "media", declared: str = "declared") -> DataFrame:
    """The kept columns and (type, corrected, found): what the media column really holds, and what could be carved from it.

    Null and empty blobs have the unknown type and nothing found; repeated rows get equal results.
    """

    def make():
        automaton = magic_automaton()

        def fn(*columns):
            blobs, types = columns[-2:]
            seen = [sniff(b, d, automaton) for b, d in zip(blobs, types)]
            return (*columns[:-1], [s[0] for s in seen], [s[1] for s in seen], [[m._asdict() for m in s[2]] for s in seen])

        return fn

    prepare(rows.sparkSession)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(rows, f"{fields}, media binary, type string, corrected boolean, found array<struct<type:string,start:long,length:long>>", make, [*keep, media, declared])


def carve(blob: bytes, found: list[dict]) -> list[bytes]:
    return [blob[m["start"] : m["start"] + m["length"]] for m in found]


def read_back(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media_type,
    embedded) for every row of docs.

    The media column is sniffed, the WAV at its start carved by its checked length, and its samples read back. media_type is
    what the column really holds, embedded how many media of any kind stand inside it. Null texts count as empty; repeated rows
    get equal results; very long texts need memory for themselves and their media; further columns are not read.
    """

    def make():
        def fn(ids, sizes, blobs, types, found):
            out = []
            for blob, kind, media in zip(blobs, types, found):
                whole = next((carve(blob, [m])[0] for m in media if m["start"] == 0 and m["type"] == "audio/wav"), b"")
                samples = from_wav(whole)
                inside = sum(m["start"] > 0 for m in media)
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), f"{kind};{features(samples)}", kind, inside))
            return (ids, sizes, *([x[i] for x in out] for i in range(8)))

        return fn

    seen = inspect_media(to_media(docs), ["doc_id", "n_bytes"])
    return map_texts(
        seen, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, embedded long",
        make, ["doc_id", "n_bytes", "media", "type", "found"],
    )
