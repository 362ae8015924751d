"""Opening and rebuilding office documents in ZIP containers."""

from __future__ import annotations

import hashlib
import io
import stat
import struct
import zipfile
import zlib
from collections.abc import Mapping
from typing import NamedTuple

from glyphmill.functions import markup
from glyphmill.functions.containers import Broken, need, without

MOST_ENTRIES = 4096
MOST_ENTRY_BYTES = 32 * 1024 * 1024
MOST_BYTES = 128 * 1024 * 1024
PROVENANCE = "META-INF/content_credential.c2pa"
OPEN_DOCUMENT = b"application/vnd.oasis.opendocument.text"
# The part that makes a container a format, and what property parts hold when they tell nothing.
MAIN_PARTS = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}
OOXML_EMPTY = {
    "docProps/core.xml": b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties"/>',
    "docProps/custom.xml": b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"/>',
    "docProps/app.xml": b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"/>',
}
ODT_EMPTY = {
    "meta.xml": b'<?xml version="1.0" encoding="UTF-8"?><office:document-meta xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0"><office:meta/></office:document-meta>',
    "manifest.rdf": b'<?xml version="1.0" encoding="UTF-8"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"/>',
}
EMPTY_PARTS = OOXML_EMPTY | ODT_EMPTY
# Parts of each format in which private attributes are looked for.
ATTRIBUTE_SCOPE = {"docx": ("word/",), "xlsx": ("xl/comments", "xl/persons"), "pptx": ("ppt/comments", "ppt/commentAuthors", "ppt/authors"), "odt": ()}


class Part(NamedTuple):
    """One entry: its place, name, way of storing, and what its content holds."""

    place: int
    name: str
    hint: str  # "odt" for the entry that makes an OpenDocument text, else ""
    private: int
    marks: int
    digest: str


def checked(data: bytes) -> zipfile.ZipFile:
    """The opened container, after all that can be told without reading an entry."""
    try:
        box = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, struct.error, ValueError, NotImplementedError, OverflowError):
        raise Broken("container") from None
    entries = box.infolist()
    need(1 <= len(entries) <= MOST_ENTRIES, "entry count")
    need(sum(e.file_size for e in entries) <= MOST_BYTES, "expanded size")
    need(len({e.filename for e in entries}) == len(entries), "repeated entry")
    for e in entries:
        steps = e.orig_filename.split("/")
        need(not ({"\\", "\0", ":"} & {*e.orig_filename}) and steps[0] and ".." not in steps and "." not in steps, "entry path")
        need(not e.flag_bits & 1, "encrypted entry")
        need(not stat.S_ISLNK(e.external_attr >> 16), "symbolic link")
        need(e.file_size <= MOST_ENTRY_BYTES, "entry size")
        need(e.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED), "compression")
        need(e.filename != PROVENANCE or e.compress_type == zipfile.ZIP_STORED, "compressed provenance")
    ends = 0
    for e in sorted(entries, key=lambda e: e.header_offset):
        need(e.header_offset == 0 or ends, "data before the container")
        need(e.header_offset >= ends and data[e.header_offset : e.header_offset + 4] == b"PK\3\4", "overlapping entries")
        need(e.header_offset + 30 <= len(data), "entry header")
        name, extra = struct.unpack_from("<HH", data, e.header_offset + 26)
        ends = e.header_offset + 30 + name + extra + e.compress_size
    return box


def content(box: zipfile.ZipFile, entry: zipfile.ZipInfo) -> bytes:
    try:
        with box.open(entry) as stream:
            out = stream.read(MOST_ENTRY_BYTES + 1)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, struct.error, RuntimeError, OSError):
        raise Broken("entry data") from None
    need(len(out) <= MOST_ENTRY_BYTES, "entry size")
    return out


def parts(data: bytes) -> list[Part]:
    """What each entry holds; every XML part is checked."""
    box = checked(data)
    out = []
    for place, entry in enumerate(box.infolist()):
        body = content(box, entry)
        private = marks = 0
        if entry.filename.endswith(".xml") and entry.filename != PROVENANCE:
            found, seen = markup.private_pieces(body, True)
            private, marks = len(found), len(seen)
        odt = not place and entry.filename == "mimetype" and entry.compress_type == zipfile.ZIP_STORED and body == OPEN_DOCUMENT
        out.append(Part(place, entry.filename, "odt" if odt else "", private, marks, hashlib.sha256(body).hexdigest()))
    return out


def rebuilt(data: bytes, actions: Mapping[int, str]) -> bytes:
    """The container with each entry treated as ``actions`` says by its place: drop, empty, scrub or keep.

    XML parts lose their safe marks in any case but the first two. Order, names
    and compression stay; times become the format's default.
    """
    box = checked(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        for place, entry in enumerate(box.infolist()):
            action = actions.get(place, "keep")
            if action == "drop":
                continue
            body = content(box, entry)
            if action == "empty":
                body = EMPTY_PARTS[entry.filename]
            elif entry.filename.endswith(".xml"):
                try:
                    body.decode()
                except UnicodeDecodeError:
                    raise Broken("XML part is no UTF-8") from None
                # An entry that keeps its attributes was taken apart before; only its marks are looked for here.
                found, seen = markup.private_pieces(body, True) if action == "scrub" else ([], markup.safe_marks(body, 0, len(body)))
                body = without(body, found + seen) if found or seen else body
            info = zipfile.ZipInfo(entry.filename)
            info.compress_type = entry.compress_type
            info.external_attr = ((entry.external_attr >> 16) & 0o777) << 16
            made.writestr(info, body)
    return out.getvalue()
