"""The rule table: which code points are marks, what they are called and what becomes of them.

One table makes everything: regular expression classes for Spark and for SQL,
replacement alphabets, and the relation that findings are joined with.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

RULE_SET_VERSION = "1"
MODES = ("safe", "strict", "maximum")
SEVERITIES = ("info", "low", "medium", "high")


class Rule(NamedTuple):
    ranges: tuple[tuple[int, int], ...]
    name: str
    category: str
    severity: str
    action: str


def _rule(ranges: str, name: str, category: str, severity: str, action: str) -> Rule:
    pairs = (r.split("-") for r in ranges.split())
    return Rule(tuple((int(p[0], 16), int(p[-1], 16)) for p in pairs), name, category, severity, action)


# Code points (hexadecimal, inclusive), name, category, severity, action.
RULES: tuple[Rule, ...] = (
    _rule("0000-0008 000B-000C 000E-001F 007F-009F", "CONTROL CHARACTER", "Control", "high", "remove_strict"),
    _rule("00AD", "SOFT HYPHEN", "Invisible format", "medium", "remove_safe"),
    _rule("034F", "COMBINING GRAPHEME JOINER", "Invisible format", "low", "remove_strict"),
    _rule("061C", "ARABIC LETTER MARK", "Bidirectional control", "medium", "remove_strict"),
    _rule("070F", "SYRIAC ABBREVIATION MARK", "Invisible format", "low", "remove_strict"),
    _rule("0890-0891 08E2", "ARABIC FORMAT MARK", "Invisible format", "low", "remove_strict"),
    _rule("115F-1160", "HANGUL FILLER", "Invisible filler", "low", "remove_strict"),
    _rule("17B4-17B5", "KHMER INHERENT VOWEL", "Invisible format", "low", "remove_strict"),
    _rule("180B-180D 180F", "MONGOLIAN VARIATION SELECTOR", "Variation selector", "low", "remove_strict"),
    _rule("180E", "MONGOLIAN VOWEL SEPARATOR", "Invisible format", "medium", "remove_strict"),
    _rule("200B", "ZERO WIDTH SPACE", "Zero-width", "high", "remove_safe"),
    _rule("200C", "ZERO WIDTH NON-JOINER", "Zero-width", "medium", "remove_strict"),
    _rule("200D", "ZERO WIDTH JOINER", "Zero-width", "medium", "remove_strict"),
    _rule("200E-200F", "DIRECTIONAL MARK", "Bidirectional control", "medium", "remove_strict"),
    _rule("202A-202C 2066-2069", "BIDI EMBEDDING OR ISOLATE", "Bidirectional control", "high", "remove_strict"),
    _rule("202D-202E", "BIDI OVERRIDE", "Bidirectional override", "high", "remove_strict"),
    _rule("2060", "WORD JOINER", "Zero-width", "medium", "remove_safe"),
    _rule("2061-2064", "INVISIBLE OPERATOR", "Invisible operator", "medium", "remove_strict"),
    _rule("206A-206F", "DEPRECATED BIDI CONTROL", "Bidirectional control", "medium", "remove_strict"),
    _rule("FEFF", "ZERO WIDTH NO-BREAK SPACE / BOM", "Zero-width", "high", "remove_safe"),
    _rule("FFF9-FFFB", "INTERLINEAR ANNOTATION CONTROL", "Annotation control", "low", "remove_strict"),
    _rule("1BCA0-1BCAF", "SHORTHAND FORMAT CONTROL", "Invisible format", "medium", "remove_strict"),
    _rule("1D173-1D17A", "MUSICAL SYMBOL CONTROL", "Invisible format", "low", "remove_strict"),
    _rule("E0000-E007F", "UNICODE TAG CHARACTER", "Tag character", "high", "remove_safe"),
    _rule("FE00-FE0F E0100-E01EF", "VARIATION SELECTOR", "Variation selector", "low", "remove_strict"),
    _rule("00A0 1680 2000-200A 202F 205F 3000", "NON-STANDARD SPACE", "Suspicious spacing", "info", "normalize_strict"),
    _rule("2018-201B", "TYPOGRAPHIC SINGLE QUOTE", "Surface typography", "info", "normalize_maximum"),
    _rule("201C-201F", "TYPOGRAPHIC DOUBLE QUOTE", "Surface typography", "info", "normalize_maximum"),
    _rule("2010-2015 2212", "DASH VARIANT", "Surface typography", "info", "normalize_maximum"),
    _rule("2026", "HORIZONTAL ELLIPSIS", "Surface typography", "info", "normalize_maximum"),
    _rule("FF01-FF5E", "FULLWIDTH ASCII VARIANT", "Compatibility character", "low", "normalize_maximum"),
    _rule("E000-F8FF F0000-FFFFD 100000-10FFFD", "PRIVATE USE CHARACTER", "Private-use payload", "high", "remove_maximum"),
)
# What the maximum mode writes for a rule's code points; full-width forms shift by FULL_WIDTH.
WRITES = {"TYPOGRAPHIC SINGLE QUOTE": "'", "TYPOGRAPHIC DOUBLE QUOTE": '"', "DASH VARIANT": "-", "HORIZONTAL ELLIPSIS": "..."}
FULL_WIDTH = 0xFEE0
# What each mode acts on.
ACTIONS = {
    "safe": ("remove_safe",),
    "strict": ("remove_safe", "remove_strict", "normalize_strict"),
    "maximum": ("remove_safe", "remove_strict", "normalize_strict", "remove_maximum", "normalize_maximum"),
}


def check_mode(mode: str) -> str:
    """``mode`` if it is one of ``MODES``, exactly so written."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    return mode


def char_class(actions: tuple[str, ...] | None = None, severity: str | None = None) -> str:
    """Regular expression class of the rules with one of ``actions`` and of ``severity``; the same for Java and RE2."""
    chosen = [r for r in RULES if (actions is None or r.action in actions) and (severity is None or r.severity == severity)]
    spans = sorted(span for r in chosen for span in r.ranges)
    return "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" if a < b else rf"\x{{{a:04X}}}" for a, b in spans) + "]" if spans else r"[^\s\S]"


def acted_on(mode: str, kind: str = "") -> str:
    """Class of what a mode acts on; ``kind`` remove or normalize narrows it."""
    return char_class(tuple(a for a in ACTIONS[check_mode(mode)] if a.startswith(kind)))


ALL = char_class()
# Characters below 256 under no rule: Java holds such a class as a table of bits.
PLAIN = r"\x20-\x7E\n\r\t\xA1-\xAC\xAE-\xFF"


def fast(char_class: str) -> str:
    """The same class for Java's matcher, which passes over a plain character by one look at a table before it tries dozens of ranges."""
    return f"(?![{PLAIN}]){char_class}"


ALL_FAST = fast(ALL)


#: Ranges of more code points than this are matched by their class and not written out.
MOST_WRITTEN_OUT = 1_000


def written_out(actions: tuple[str, ...]) -> str:
    """The characters of the rules with one of ``actions``, but for those in long ranges."""
    return "".join(chr(c) for r in RULES if r.action in actions for a, b in r.ranges if b - a < MOST_WRITTEN_OUT for c in range(a, b + 1))


def long_ranges(actions: tuple[str, ...]) -> str:
    """Class of the long ranges of the rules with one of ``actions``; empty if there are none."""
    spans = sorted((a, b) for r in RULES if r.action in actions for a, b in r.ranges if b - a >= MOST_WRITTEN_OUT)
    return "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in spans) + "]" if spans else ""


def one_to_one() -> tuple[str, str]:
    """Alphabets of the replacements of one character by one, without spaces: for translate."""
    source, target = "", ""
    for r in RULES:
        if r.action == "normalize_maximum" and r.name != "HORIZONTAL ELLIPSIS":
            for a, b in r.ranges:
                for c in range(a, b + 1):
                    source += chr(c)
                    target += WRITES.get(r.name) or chr(c - FULL_WIDTH)
    return source, target


def written(rule: Rule) -> str | None:
    """What stands for a rule's code points: None if they go, "" if each has its own."""
    if not rule.action.startswith("normalize"):
        return None
    return " " if rule.action == "normalize_strict" else WRITES.get(rule.name, "")


SCHEMA = "rule_no int, lo int, hi int, name string, category string, severity string, action string, replacement string"


def relation(spark: SparkSession) -> DataFrame:
    """One row for each of the 47 ranges."""
    rows = [(n, a, b, r.name, r.category, r.severity, r.action, written(r)) for n, r in enumerate(RULES, 1) for a, b in r.ranges]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


BLOCK_BITS = 8


def blocks(spark: SparkSession) -> DataFrame:
    """The relation with a row for each block of 256 code points that a range touches, so that a lookup is an equi-join.

    Its size is fixed by the rule table: under 800 rows.
    """
    rows = [
        (block, n, a, b, r.name, r.category, r.severity, r.action, written(r))
        for n, r in enumerate(RULES, 1)
        for a, b in r.ranges
        for block in range(a >> BLOCK_BITS, (b >> BLOCK_BITS) + 1)
    ]
    return spark.createDataFrame(rows, f"block int, {SCHEMA}").coalesce(1)
