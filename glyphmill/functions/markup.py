"""Reading XML as spans of its own bytes, so that what is kept is kept to the byte.

Markup is checked (balanced tags, well-formed attributes without repeats) but
neither decoded nor rewritten: character references stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from glyphmill.functions import rules
from glyphmill.functions.containers import Piece, need

TOKEN = re.compile(
    rb"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|(?P<doctype><!DOCTYPE\b)"
    rb"|</(?P<end>[^\s<>/]++)\s*+>|<(?P<start>[^\s<>/!?=\"']++)(?P<attributes>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|(?P<text>[^<]++)",
    re.S,
)
# Quantifiers give nothing back, and attributes are matched one after another: a run of blanks is gone over once.
ATTRIBUTE = re.compile(rb"\s++([^\s<>=\"'/]++)\s*+=\s*+(?:\"([^\"<]*+)\"|'([^'<]*+)')", re.S)
ANGLE = re.compile(rb"[<>]")
SAFE_MARK = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for r in rules.RULES if r.action == "remove_safe" for a, b in r.ranges) + "]")
# Attributes that tell who worked on a document and when; how references that leave it begin.
PRIVATE_ATTRIBUTES = frozenset((b"author", b"initials", b"date", b"creator", b"lastModifiedBy"))
OUTSIDE = (b"http:", b"https:", b"//", b"data:", b"javascript:", b"file:")
REMOVED_ELEMENTS = {b"metadata": "svg-metadata", b"script": "active-content"}


class Token(NamedTuple):
    kind: str  # start, empty, end, text, cdata, comment, doctype or other
    start: int
    stop: int
    name: bytes
    attributes: list[tuple[int, int, bytes, int, int]]  # start, stop (with the blanks before), name, start and stop of the value


def local(name: bytes) -> bytes:
    return name.rpartition(b":")[2]


def tokens(data: bytes, declarations: bool = False) -> Iterator[Token]:
    """The tokens of an XML file; breaks off where it is malformed, or has a document type and ``declarations`` are not allowed."""
    at, opened = 0, []
    while at < len(data):
        m = TOKEN.match(data, at)
        need(m, "malformed markup")
        at = m.end()
        kind = m.lastgroup
        if kind == "end":
            need(opened and opened.pop() == m["end"], "unbalanced tags")
            yield Token("end", m.start(), at, m["end"], [])
        elif m["start"] is not None:
            inner, base = m["attributes"], m.start("attributes")
            empty = inner.endswith(b"/")
            inner = inner[:-1] if empty else inner
            found, pos = [], 0
            while a := ATTRIBUTE.match(inner, pos):
                pos, group = a.end(), 2 if a[2] is not None else 3
                found.append((base + a.start(), base + a.end(), a[1], base + a.start(group), base + a.end(group)))
            need(not inner[pos:].strip(), "malformed attribute")
            need(len({a[2] for a in found}) == len(found), "repeated attribute")
            if not empty:
                opened.append(m["start"])
            yield Token("empty" if empty else "start", m.start(), at, m["start"], found)
        elif kind == "doctype":
            need(declarations, "document type declaration")
            level = 1
            for bracket in ANGLE.finditer(data, at):
                level += 1 if bracket[0] == b"<" else -1
                if not level:
                    break
            need(not level, "malformed markup")
            at = bracket.end()
            yield Token("other", m.start(), at, b"", [])
        elif kind in ("text", "cdata", "comment"):
            yield Token(kind, m.start(kind), at if kind != "cdata" else m.end(kind), b"", [])
        else:
            yield Token("other", m.start(), at, b"", [])
    need(not opened, "unclosed element")


def safe_marks(data: bytes, start: int, stop: int) -> list[tuple[int, int]]:
    """Byte spans of the marks that the safe mode removes; none in what is no UTF-8."""
    try:
        text = data[start:stop].decode()
    except UnicodeDecodeError:
        return []
    if text.isascii():
        return []
    out, seen, at = [], 0, start
    for m in SAFE_MARK.finditer(text):
        at += len(text[seen : m.start()].encode())
        size = len(m[0].encode())
        out.append((at, at + size))
        seen, at = m.end(), at + size
    return out


def outside(value: bytes) -> bool:
    """Whether a reference leaves the document; one that is no UTF-8 counts as such."""
    try:
        return value.decode().strip().encode().lower().startswith(OUTSIDE)
    except UnicodeDecodeError:
        return True


def svg_pieces(data: bytes) -> list[Piece]:
    """What is private or active in an SVG file: spans with the kind of finding as their tag. May nest."""
    need(data, "no data")
    out: list[Piece] = []
    root = False
    depth = 0
    waiting: list[tuple[int, int, str]] = []  # open elements that go: depth, start, kind
    for t in tokens(data):
        if t.kind in ("start", "empty"):
            own = local(t.name)
            need(root or own == b"svg", "root is not svg")
            root = True
            kind = REMOVED_ELEMENTS.get(own) or ("c2pa" if own == b"manifest" and t.name.startswith(b"c2pa:") else "")
            if kind and t.kind == "empty":
                out.append((t.start, t.stop, kind, ""))
            elif kind:
                waiting.append((depth, t.start, kind))
            depth += t.kind == "start"
            for start, stop, name, a, b in t.attributes:
                name = local(name)
                if len(name) > 2 and name[:2].lower() == b"on":
                    out.append((start, stop, "active-content", ""))
                elif name == b"href" and outside(data[a:b]):
                    out.append((start, stop, "external-references", ""))
                out += [(x, y, "unicode", "") for x, y in safe_marks(data, a, b)]
        elif t.kind == "end":
            depth -= 1
            if waiting and waiting[-1][0] == depth:
                _, start, kind = waiting.pop()
                out.append((start, t.stop, kind, ""))
        elif t.kind == "comment":
            out.append((t.start - 4, t.stop, "svg-comments", ""))
        elif t.kind in ("text", "cdata"):
            out += [(x, y, "unicode", "") for x, y in safe_marks(data, t.start, t.stop)]
    need(root, "no root element")
    return out


def private_pieces(data: bytes, attributes: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of private attributes (if asked for) and of marks in a document's XML part."""
    found = [(a[0], a[1]) for t in tokens(data, declarations=True) for a in t.attributes if local(a[2]) in PRIVATE_ATTRIBUTES]
    return (found if attributes else []), safe_marks(data, 0, len(data))
