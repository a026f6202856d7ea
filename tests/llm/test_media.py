"""Media columns: exact round trips, format checks, carving, wrong declarations."""

import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media as M

AC = M.magic_automaton()


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4cdxx\xff\0yy\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF"
MP4 = struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4s", 8, b"mdat")
KINDS = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 99), "video/mp4": MP4, "audio/wav": M.to_wav(b"abc"), "image/x-portable-graymap": b"P5\n2 2\n255\nabcd"}


def test_types_are_corrected():
    for kind, blob in KINDS.items():
        assert M.sniff(blob, "text/plain", AC)[:2] == (kind, True), kind
        assert M.sniff(blob, kind, AC)[1] is False
        if kind != "application/pdf":
            assert M.sniff(blob[: len(blob) // 2], kind, AC)[0] == M.UNKNOWN, kind
    assert M.sniff(None, "x", AC) == (M.UNKNOWN, True, []) and M.sniff(b"", M.UNKNOWN, AC)[1] is False


def test_carving():
    parts = [png(), GIF, JPEG, M.to_wav(b"abcd"), b"P5\n2 2\n255\nabcd"]
    blob = b"junk BM RIFF".join([b"", *parts, b"GIF89a tail"])
    found = [m for m in M.find_media(blob, AC, embedded=False)]
    assert M.carve(blob, [m._asdict() for m in found]) == parts


def tiff():
    strip, entry = b"pixels", 8 + 6
    tags = [(256, 4, 1, 3), (257, 4, 1, 2), (258, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, len(strip)), (270, 2, 9, entry + 6 + 12 * 6)]
    return b"II*\0" + struct.pack("<I", entry) + strip + struct.pack("<H", 6) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4 + b"described"


def flac(total=None):
    """Two frames of one channel: a verbatim one, and one of a fixed predictor with Rice codes."""
    def crc(data, poly, bits):
        x = 0
        for byte in data:
            x ^= byte << (bits - 8)
            for _ in range(8):
                x = (x << 1 ^ (poly if x >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        return x.to_bytes(bits // 8, "big")

    out, n = b"", 16
    for i, body in enumerate(("0" + "000001" + "0" + "".join(f"{7 * x % 256:08b}" for x in range(n)), "0" + "001001" + "0" + f"{5:08b}" + "00" + "0000" + "0010" + "".join("0" * (x % 7) + "1" + f"{x % 4:02b}" for x in range(n - 1)))):
        head = bytes([0xFF, 0xF8, 0x60, 0x02, i, n - 1])
        head += crc(head, 0x07, 8)
        frame = head + int(body.ljust(-(-len(body) // 8) * 8, "0"), 2).to_bytes(-(-len(body) // 8), "big")
        out += frame + crc(frame, 0x8005, 16)
    told = (8000 << 44 | 7 << 36 | (2 * n if total is None else total)).to_bytes(8, "big")
    return b"fLaC\0\0\0\x22" + struct.pack(">HH", n, n) + b"\0" * 6 + told + b"\0" * 16 + b"\x84\0\0\5notes" + out


def matroska(known=True):
    sized = lambda kind, data, say=True: kind + (bytes([0x80 | len(data)]) if say else b"\xff") + data
    cluster = sized(b"\x1fC\xb6u", sized(b"\xe7", b"\0") + sized(b"\xa3", b"\x81\0\0\x80xyz"), known)
    return sized(b"\x1aE\xdf\xa3", sized(b"B\x82", b"webm")) + sized(b"\x18S\x80g", sized(b"\x15I\xa9f", b"") + cluster + sized(b"\x1cS\xbbk", b"q"), known)


UPDATED = PDF + b"\n2 0 obj\nendobj\nstartxref\n9\n%%EOF"


def test_embedded_media_have_their_own_lengths():
    junk = b"\0 what follows is not of it "
    whole = {"image/bmp": [BMP], "image/tiff": [tiff()], "audio/flac": [flac(), flac(0)], "video/x-matroska": [matroska(), matroska(False)], "application/pdf": [PDF, UPDATED]}
    for kind, blobs in whole.items():
        for blob in blobs:
            for before in (b"", b"some bytes before "):
                found = [m for m in M.find_media(before + blob + junk, AC, embedded=False)]
                assert [(m.type, m.start, m.length) for m in found] == [(kind, len(before), len(blob))], (kind, before)
            if kind not in ("application/pdf",) and blob not in (flac(0), matroska(False)):
                assert not [m for m in M.find_media(blob[:-1], AC) if m.type == kind], kind
    two = [m.length for m in M.find_media(UPDATED + junk + PDF, AC)]
    assert two == [len(UPDATED), len(PDF)]


def test_updates_of_a_pdf_that_hold_a_pdf():
    first = b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF\n"
    update = b"3 0 obj\nstream\n" + first + b"endstream\nendobj\n"
    whole = first + update + b"xref\nstartxref\n%d\n%%%%EOF" % len(first + update)
    assert M.find_media(b"x" + whole + b" x", AC, embedded=False) == [M.Media("application/pdf", 1, len(whole))]
    assert [m.length for m in M.find_media(first + first, AC)] == [len(first.rstrip())] * 2


def plain_pdf(b, at):
    """The end of a PDF by looking at every later section in turn."""
    first = b.find(b"%%EOF", at)
    if first < 0 or b.find(b"startxref", at, first) < 0:
        return 0
    upto = first + 5
    for m in M.PDF_END.finditer(b, upto):
        place = at + int(m[1])
        if b.find(b"%PDF-", upto, m.end()) < 0 or upto <= place < m.start() and M.XREF.match(b, place):
            upto = m.end()
    return upto - at


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"%PDF-1.4\n", b"xref\n", b"startxref\n9\n%%EOF\n", b"startxref\n40\n%%EOF", b"startxref 75 %%EOF ", b"1 0 obj", b"junk ", b"%%EOF"]), max_size=14))
def test_sections_of_a_pdf_by_brute_force(parts):
    blob = b"".join(parts)
    look = M.Look(blob)
    at = blob.find(b"%PDF-")
    while at >= 0:
        assert M._pdf(blob, at, look) == plain_pdf(blob, at)
        at = blob.find(b"%PDF-", at + 1)


def test_time_grows_with_the_blob():
    import time

    def seconds(blob):
        began = time.process_time()
        M.find_media(blob, AC)
        return time.process_time() - began

    for part in (b"%PDF-", b"%PDF-startxref 1 %%EOF ", b"PK\x03\x04", b"\x1f\x8b\x08", b"\0\0\0\x08ftyp", b"OggS\0" + b"\0" * 22, b"\x1aE\xdf\xa3\x40\xff", b"BM", b"RIFF", b"II*\0", b"GIF89aABCDEFG!x", b"GIF89aABCDEFG!x\x01"):
        small, large = min(seconds(part * 4000) for _ in range(3)), min(seconds(part * 16000) for _ in range(2))
        assert large < 4 * 2.5 * max(small, 0.006), (part, small, large)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=700))
def test_round_trip(text):
    payload, n = M.payload_of(text)
    raw = text.encode("utf-8", "surrogatepass")
    assert n == len(raw) and payload.startswith(raw) and len(payload) % 192 == 0 and len(payload) > 0 and not payload[n:].strip(b" ") and len(payload) - n <= 192
    blob = M.to_wav(payload)
    assert M.sniff(blob, "", AC)[0] == "audio/wav" and M.from_wav(blob) == payload


def test_query(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "GIF89a RIFF BM", "x"), (4, "é" * 96, "x"), (4, "é" * 96, "x"), (None, "z" * 50000, "x")], "doc_id long, text string, media string")
    got = M.read_back(docs).collect()
    for r in got:
        text = {1: "", 2: "", 3: "GIF89a RIFF BM", 4: "é" * 96, None: "z" * 50000}[r["doc_id"]]
        payload, n = M.payload_of(text)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(M.to_wav(payload)).hexdigest() and r["media_bytes"] == len(payload) + 44 and r["feature"].startswith("audio/wav;")
        assert (r["media_type"], r["embedded"]) == ("audio/wav", 0)
    assert len(got) == 6 and M.read_back(docs.where("false")).count() == 0
    held = spark.createDataFrame([(1, "look: P5\n2 2 255\nabcd and P6\n1 1 255\nxyz.", "x")], "doc_id long, text string, media string")
    assert M.read_back(held).first()["embedded"] == 2
