"""Reading PDF files as objects with the spans of their dictionaries' entries.

Objects are read in file order, the last of a number wins; streams are passed over
by their length, and compressed object streams are opened. That covers cross-
reference tables and streams, and incremental updates, alike. What the
references leave out (freed objects) stays an object like any other.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

from glyphmill.functions.containers import Broken, need

MOST_OBJECTS = 100_000
MOST_STREAM_BYTES = 128 * 1024 * 1024
MOST_DEPTH = 100
MOST_DIGITS = 18
MOST_NUMBER = 8_388_607  # the format's own limit on object numbers

BLANK = rb"\x00\t\n\x0c\r "
SKIP = re.compile(rb"(?:[%s]|%%[^\r\n]*)*" % BLANK)
HEAD = re.compile(rb"(?<![0-9])(\d{1,10})[%s]+(\d{1,5})[%s]+obj(?![A-Za-z])" % (BLANK, BLANK))
REFERENCE = re.compile(rb"(\d{1,10})[%s]+(\d{1,5})[%s]+R(?![A-Za-z0-9])" % (BLANK, BLANK))
NAME = re.compile(rb"/[^%s()<>\[\]{}/%%]*" % BLANK)
WORD = re.compile(rb"[^%s()<>\[\]{}/%%]+" % BLANK)
HEX = re.compile(rb"<[0-9A-Fa-f%s]*>" % BLANK)
PARENS = re.compile(rb"\\.|[()]", re.S)
STREAM = re.compile(rb"stream(?:\r\n|\n|\r)")
TRAILER = re.compile(rb"trailer(?![A-Za-z])")
ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")


class Entry(NamedTuple):
    start: int
    stop: int
    value: object  # a name as str, a number as int, a reference as (number, generation), a dictionary, or None


def number(digits: bytes) -> int:
    """An object's number."""
    need(len(digits) <= MOST_DIGITS and int(digits) <= MOST_NUMBER, "object number")
    return int(digits)


def after_blank(data: bytes, at: int) -> int:
    return SKIP.match(data, at).end()


def value(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The value that begins at ``at``, and its end; strings and arrays are passed over."""
    need(depth < MOST_DEPTH and at < len(data), "malformed object")
    c = data[at : at + 1]
    if c == b"/":
        m = NAME.match(data, at)
        return ESCAPE.sub(lambda x: bytes([int(x[1], 16)]), m[0][1:]).decode("latin-1"), m.end()
    if data.startswith(b"<<", at):
        return dictionary(data, at, depth)
    if c == b"<":
        m = HEX.match(data, at)
        need(m, "malformed string")
        return None, m.end()
    if c == b"(":
        level, at = 1, at + 1
        while level:
            m = PARENS.search(data, at)
            need(m, "unclosed string")
            level += {b"(": 1, b")": -1}.get(m[0], 0)
            at = m.end()
        return None, at
    if c == b"[":
        items, at = [], after_blank(data, at + 1)
        while not data.startswith(b"]", at):
            item, at = value(data, at, depth + 1)
            items.append(item)
            at = after_blank(data, at)
        return items, at + 1
    if m := REFERENCE.match(data, at):
        return (number(m[1]), int(m[2])), m.end()
    m = WORD.match(data, at)
    need(m, "malformed object")
    return (int(m[0]) if m[0].isdigit() and len(m[0]) <= MOST_DIGITS else None), m.end()


def dictionary(data: bytes, at: int, depth: int = 0) -> tuple[dict[str, Entry], int]:
    """A dictionary with the span of each entry."""
    out: dict[str, Entry] = {}
    at = after_blank(data, at + 2)
    while not data.startswith(b">>", at):
        need(data.startswith(b"/", at), "malformed dictionary")
        start = at
        key, at = value(data, at, depth + 1)
        item, at = value(data, after_blank(data, at), depth + 1)
        out[key] = Entry(start, at, item)
        at = after_blank(data, at)
    return out, at + 2


DIRECT = (0, 0)  # stands for what a trailer holds itself; no object has this number


class Thing(NamedTuple):
    """An object: number, generation, its own bytes, its top-level dictionary (spans within ``raw``) and the stream's data."""

    number: int
    generation: int
    raw: bytes
    entries: dict[str, Entry]
    stream: bytes | None

    def name(self, key: str) -> str | None:
        found = self.entries.get(key)
        return found.value if found and isinstance(found.value, str) else None


def read(data: bytes) -> tuple[list[Thing], dict[str, tuple[int, int]]]:
    """The objects of a file by number, and the trailer's references."""
    need(data.startswith(b"%PDF-"), "signature")
    found: dict[int, Thing] = {}
    lengths: list[tuple[int, int]] = []
    trailer: dict[str, tuple[int, int]] = {}
    heads: dict[tuple[int, int], int] | None = None
    packed: list[Thing] = []
    at = total = 0

    def note(entries: dict[str, Entry]) -> None:
        need("Encrypt" not in entries, "encrypted")
        trailer.update({k: e.value for k, e in entries.items() if isinstance(e.value, tuple)})
        if "Info" in entries and isinstance(entries["Info"].value, dict):
            trailer["Info"] = DIRECT

    m = HEAD.search(data)
    while True:
        if m and m.start() < at:
            m = HEAD.search(data, at)
        t = TRAILER.search(data, at, m.start() if m else len(data))
        if t:
            start = after_blank(data, t.end())
            if data.startswith(b"<<", start):
                entries, at = dictionary(data, start)
                note(entries)
                continue
        if not m:
            break
        start = after_blank(data, m.end())
        item, end = value(data, start)
        entries = {k: Entry(e.start - start, e.stop - start, e.value) for k, e in item.items()} if isinstance(item, dict) else {}
        stream = None
        s = STREAM.match(data, after_blank(data, end))
        at = end
        if s and isinstance(item, dict):
            size = item["Length"].value if "Length" in item else None
            if isinstance(size, tuple):
                if heads is None:  # streams that tell their length are not looked through
                    heads = {(int(m[1]), int(m[2])): m.end() for m in HEAD.finditer(data)}
                where = heads.get(size)
                need(where is not None, "stream length")
                size, _ = value(data, after_blank(data, where))
            need(isinstance(size, int) and s.end() + size <= len(data), "stream length")
            stream = data[s.end() : s.end() + size]
            at = s.end() + size
            need(data.startswith(b"endstream", after_blank(data, at)), "stream end")
            total += size
            need(total <= MOST_STREAM_BYTES, "stream bytes")
        thing = Thing(number(m[1]), int(m[2]), data[start:end], entries, stream)
        kind = thing.name("Type")
        if kind == "XRef":
            note(entries)
        elif kind == "ObjStm":
            packed.append(thing)
        else:
            found[thing.number] = thing
        need(len(found) <= MOST_OBJECTS, "object count")
    for thing in packed:
        for inner in unpacked(thing):
            found.setdefault(inner.number, inner)
            need(len(found) <= MOST_OBJECTS, "object count")
    need(found, "no objects")
    need(isinstance(trailer.get("Root"), tuple) and trailer["Root"][0] in found, "no catalog")
    need(found[trailer["Root"][0]].name("Type") == "Catalog", "no catalog")
    return [found[n] for n in sorted(found)], trailer


def unpacked(thing: Thing) -> list[Thing]:
    """The objects in an object stream."""
    filters = thing.entries["Filter"].value if "Filter" in thing.entries else []
    filters = filters if isinstance(filters, list) else [filters]
    need(filters in ([], ["FlateDecode"]) and thing.stream is not None, "object stream filter")
    body = thing.stream
    if filters:
        opened = zlib.decompressobj()
        try:
            body = opened.decompress(body, MOST_STREAM_BYTES)
        except zlib.error:
            raise Broken("object stream data") from None
        need(not opened.unconsumed_tail, "stream bytes")
    first, count = (thing.entries[k].value if k in thing.entries else None for k in ("First", "N"))
    need(isinstance(first, int) and isinstance(count, int) and count <= MOST_OBJECTS, "object stream header")
    numbers = body[:first].split()
    need(len(numbers) >= 2 * count and all(x.isdigit() and len(x) <= MOST_DIGITS for x in numbers[: 2 * count]), "object stream header")
    out = []
    for i in range(count):
        start = after_blank(body, first + int(numbers[2 * i + 1]))
        item, end = value(body, start)
        entries = {k: Entry(e.start - start, e.stop - start, e.value) for k, e in item.items()} if isinstance(item, dict) else {}
        out.append(Thing(number(numbers[2 * i]), 0, body[start:end], entries, None))
    return out


def written(objects: list[tuple[int, int, bytes, bytes | None]], root: tuple[int, int]) -> bytes:
    """A file of the given objects (number, generation, bytes, stream) with one fresh reference table, and no history."""
    out = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"]
    size = len(out[0])
    places = {}
    for number, generation, raw, stream in sorted(objects):
        places[number] = (size, generation)
        out.append(b"%d %d obj\n%s\n" % (number, generation, raw) + (b"stream\n%s\nendstream\n" % stream if stream is not None else b"") + b"endobj\n")
        size += len(out[-1])
    # A section of the table for each run of numbers, so that it grows with the objects and not with their numbers.
    runs: list[list[int]] = [[0]]
    for n in sorted(places):
        if n > 0:
            runs[-1].append(n) if n == runs[-1][-1] + 1 else runs.append([n])
    out.append(b"xref\n")
    for run in runs:
        out.append(b"%d %d\n" % (run[0], len(run)) + b"".join(b"%010d %05d n\r\n" % places[n] if n else b"0000000000 65535 f\r\n" for n in run))
    most = max(places, default=0)
    out.append(b"trailer\n<< /Size %d /Root %d %d R >>\nstartxref\n%d\n%%%%EOF\n" % (most + 1, *root, size))
    return b"".join(out)
