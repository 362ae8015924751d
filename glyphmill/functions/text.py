"""Text hygiene as column expressions: everything here stays in the JVM and needs no shuffle."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import rules

TEXT_LIMIT = 8 * 1024 * 1024
# The scope that each mode's verification covers, and what is said of statistical marks.
SCOPES = {"safe": "deterministic-safe-unicode", "strict": "deterministic-strict-unicode", "maximum": "deterministic-unicode-and-token-surface"}
VENDOR_STATUS = "not-verifiable-without-vendor-detector"


def sanitize(text: Column, mode: str) -> Column:
    """``text`` after the mode's removals and replacements; null stays null.

    One pass translates all characters that go or become another one. The classes
    are disjoint and what is written is printable ASCII, so the order of the steps
    does not matter and a second pass changes nothing.
    """
    actions = rules.ACTIONS[rules.check_mode(mode)]
    removed = tuple(a for a in actions if a.startswith("remove"))
    source, target = rules.one_to_one() if mode == "maximum" else ("", "")
    if mode != "safe":
        spaces = rules.written_out(("normalize_strict",))
        source, target = source + spaces, target + " " * len(spaces)
    # Characters beyond the target's end go.
    out = F.translate(text, source + rules.written_out(removed), target)
    if long := rules.long_ranges(removed):
        out = F.regexp_replace(out, F.lit(rules.fast(long)), F.lit(""))
    return F.replace(out, F.lit("…"), F.lit("...")) if mode == "maximum" else out


def projection(text: Column) -> Column:
    """The canonical projection: ``text`` as the maximum mode leaves it."""
    return sanitize(text, "maximum")


def removed_count(text: Column, mode: str) -> Column:
    """Code points that the mode removes."""
    return F.regexp_count(text, F.lit(rules.fast(rules.acted_on(mode, "remove")))).cast("long")


def normalized_count(text: Column, mode: str) -> Column:
    """Code points that the mode replaces."""
    return F.regexp_count(text, F.lit(rules.fast(rules.acted_on(mode, "normalize")))).cast("long")


def is_clean(text: Column, mode: str) -> Column:
    """Whether nothing is left for the mode to act on."""
    return ~text.rlike(rules.fast(rules.acted_on(mode)))


def finding_count(text: Column) -> Column:
    """Marks of any rule."""
    return F.regexp_count(text, F.lit(rules.ALL_FAST)).cast("long")


def severity_count(text: Column, severity: str) -> Column:
    """Marks of the rules of one severity."""
    return F.regexp_count(text, F.lit(rules.fast(rules.char_class(severity=severity)))).cast("long")


def required_mode(text: Column) -> Column:
    """The mildest mode that leaves no mark; null if there is none to begin with."""
    has = lambda *actions: text.rlike(rules.fast(rules.char_class(actions)))
    return (
        F.when(has("remove_maximum", "normalize_maximum"), "maximum")
        .when(has("remove_strict", "normalize_strict"), "strict")
        .when(has("remove_safe"), "safe")
    )


def verify_status(output: Column, mode: str) -> Column:
    """``CLEAN`` without any mark, ``POLICY ONLY`` if only the mode's own are gone, else ``REVIEW``; null for a null text."""
    return F.when(~is_clean(output, mode), "REVIEW").when(output.rlike(rules.ALL_FAST), "POLICY ONLY").when(output.isNotNull(), "CLEAN")


def next_mode(output: Column, mode: str) -> Column:
    """The mode to offer next: the one the output still needs, if it is another one."""
    needed = required_mode(output)
    return F.when(is_clean(output, mode) & (needed != mode), needed)


def text_error(text: Column, limit: int = TEXT_LIMIT) -> Column:
    """Why a text is not taken, or null: ``text-too-large`` or ``invalid-utf8``. Null texts have no error."""
    return F.when(F.octet_length(text) > limit, "text-too-large").when(~F.is_valid_utf8(text), "invalid-utf8")


def codepoint_name(codepoint: Column) -> Column:
    """``U+`` and at least four hexadecimal digits."""
    return F.format_string("U+%04X", codepoint)


def ledger_label(text: Column) -> Column:
    """How a ledger shows a change's side: a sign for nothing and for blanks, else the character and its number."""
    return (
        F.when(text == "", "∅").when(text == " ", "SPACE").when(text == "\n", "LF").when(text == "\t", "TAB")
        .otherwise(F.concat(text, F.lit(" · "), codepoint_name(F.ascii(text))))
    )


def human_bytes(size: Column, ties_to_even: bool = False) -> Column:
    """A size in B, KiB (one decimal) or MiB (two); what lies halfway goes up, or with ``ties_to_even`` to the even digit, as SQL's printf has it."""
    if ties_to_even:
        exact = size.cast("decimal(17,0)")  # both parts of a size are told without loss
        kib, mib = (F.bround(exact * F.lit(Decimal(f"{1 / unit:.{digits}f}")), n).cast("string") for unit, digits, n in ((1024, 10, 1), (1048576, 20, 2)))
        label = F.when(size < 1024 * 1024, F.concat(kib, F.lit(" KiB"))).otherwise(F.concat(mib, F.lit(" MiB")))
    else:
        label = F.when(size < 1024 * 1024, F.format_string("%.1f KiB", size / 1024.0)).when(size.isNotNull(), F.format_string("%.2f MiB", size / 1048576.0))
    return F.when(size < 1024, F.format_string("%d B", size)).otherwise(label)


def base_name(name: Column, fallback: str = "document") -> Column:
    """A file name without its last extension; ``fallback`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("")), F.lit(fallback))


def export_name(name: Column) -> Column:
    """Name of a sanitized text file."""
    return F.concat(base_name(name), F.lit(".sanitized.txt"))


def safe_base_name(name: Column, fallback: str = "file") -> Column:
    """Base name of at most 120 characters, of letters, digits, dots, underscores and hyphens."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[^a-zA-Z0-9._-]", "_"), 1, 120)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))


def clean_file_name(name: Column, file_format: Column) -> Column:
    """Name of a cleaned binary file; jpeg is written jpg."""
    return F.concat(safe_base_name(name), F.lit(".clean."), F.when(file_format == "jpeg", "jpg").otherwise(file_format))
