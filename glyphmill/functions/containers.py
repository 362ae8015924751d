"""Cutting image files into pieces: each helper turns one file's bytes into (start, stop, tag, hint) rows.

They check the container's structure and say nothing of what a piece means: that
is a join with a table of tags, done by Spark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

Piece = tuple[int, int, str, str]

PNG_START = b"\x89PNG\r\n\x1a\n"
JPEG_START = b"\xff\xd8"
XMP_SPACE = b"http://ns.adobe.com/xap/1.0/"


class Broken(Exception):
    """A file that breaks its format's rules; the message says which."""


def need(condition: object, why: str) -> None:
    if not condition:
        raise Broken(why)


def png_pieces(data: bytes) -> list[Piece]:
    """Chunks of a PNG file, with sizes, order and checksums checked."""
    need(data.startswith(PNG_START), "signature")
    out: list[Piece] = []
    at = len(PNG_START)
    while not out or out[-1][2] != "IEND":
        need(len(data) - at >= 12, "truncated chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        need(end <= len(data), "chunk beyond the file")
        need(kind.isalpha(), "chunk type")
        need(zlib.crc32(data[at + 4 : end - 4]) == struct.unpack_from(">I", data, end - 4)[0], "checksum")
        tag = kind.decode("ascii")
        need((tag == "IHDR") == (not out), "header chunk")
        need(tag != "IHDR" or size == 13, "header size")
        need(tag != "IEND" or size == 0, "end chunk")
        out.append((at, end, tag, ""))
        at = end
    need(at == len(data), "data after the end")
    need(any(p[2] == "IDAT" for p in out), "no image data")
    return out


def segment_hint(marker: int, body: bytes) -> str:
    """What a JPEG segment's own bytes say of it."""
    if marker == 0xE1:
        return "exif" if body.startswith(b"Exif\0\0") else "xmp" if XMP_SPACE in body else ""
    return "c2pa" if marker == 0xEB and b"c2pa" in body else ""


def jpeg_pieces(data: bytes) -> list[Piece]:
    """Segments of a JPEG file that have a length, tagged by their marker; scan data stays between them."""
    need(data.startswith(JPEG_START), "signature")
    out: list[Piece] = []
    at = 2
    while True:
        need(at + 1 < len(data), "no end marker")
        need(data[at] == 0xFF, "marker expected")
        start = at
        while at < len(data) and data[at] == 0xFF:
            at += 1
        need(at < len(data), "no end marker")
        marker = data[at]
        at += 1
        need(marker not in (0x00, 0xD8), "illegal marker")
        if marker == 0xD9:
            need(at == len(data), "data after the end")
            return out
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        need(at + 2 <= len(data), "truncated segment")
        size = int.from_bytes(data[at : at + 2], "big")
        need(size >= 2 and at + size <= len(data), "segment length")
        out.append((start, at + size, f"{marker:02X}", segment_hint(marker, data[at + 2 : at + size])))
        at += size
        while marker == 0xDA:  # the scan runs to the first marker that is no restart
            at = data.find(b"\xff", at)
            need(at >= 0 and at + 1 < len(data), "scan without an end")
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 2
            else:
                break


def webp_pieces(data: bytes) -> list[Piece]:
    """Chunks of a WebP file, padding included."""
    need(len(data) >= 20 and data[:4] == b"RIFF" and data[8:12] == b"WEBP", "signature")
    need(int.from_bytes(data[4:8], "little") + 8 == len(data), "file size")
    out: list[Piece] = []
    at = 12
    while at < len(data):
        need(at + 8 <= len(data), "truncated chunk")
        kind, size = struct.unpack_from("<4sI", data, at)
        end = at + 8 + size
        need(all(0x20 <= c <= 0x7E for c in kind), "chunk type")
        need(end + size % 2 <= len(data), "chunk beyond the file")
        need(size % 2 == 0 or data[end] == 0, "padding")
        tag = kind.decode("ascii")
        need(tag != "VP8X" or size == 10, "extended header")
        out.append((at, end + size % 2, tag, ""))
        at = end + size % 2
    tags = [p[2] for p in out]
    need({"VP8 ", "VP8L", "ANMF"} & {*tags}, "no image data")
    need("C2PA" not in tags[:-1], "provenance chunk not last")
    return out


def without(data: bytes, spans: Iterable[tuple[int, int]]) -> bytes:
    """``data`` without the spans, which may touch or nest."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start > at:
            out.append(data[at:start])
        at = max(at, stop)
    return b"".join([*out, data[at:]])


def webp_finished(data: bytes) -> bytes:
    """A cut WebP file with its size and the flags of its extended header put right."""
    out = bytearray(data)
    out[4:8] = (len(out) - 8).to_bytes(4, "little")
    at = 12
    while at + 8 <= len(out):
        kind, size = struct.unpack_from("<4sI", out, at)
        if kind == b"VP8X":
            out[at + 8] &= 0xF3  # neither EXIF nor XMP
        at += 8 + size + size % 2
    return bytes(out)
