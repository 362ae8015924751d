"""The text functions under SQL names, for sessions that speak SQL."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from glyphmill.functions import rules

SPANS = sorted((a, b, r) for r in rules.RULES for a, b in r.ranges)
STARTS = [a for a, _, _ in SPANS]
MARK = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b, _ in SPANS) + "]")


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sanitized(mode: str, text: str = "text") -> str:
    """Spark SQL for ``functions.text.sanitize``."""
    out = f"regexp_replace({text}, {literal(rules.acted_on(mode, 'remove'))}, '')"
    if mode != "safe":
        out = f"regexp_replace({out}, {literal(rules.char_class(('normalize_strict',)))}, ' ')"
    if mode == "maximum":
        source, target = rules.one_to_one()
        out = f"replace(translate({out}, {literal(source)}, {literal(target)}), '…', '...')"
    return out


def needed(text: str = "text") -> str:
    """Spark SQL for ``functions.text.required_mode``."""
    has = lambda *actions: f"{text} rlike {literal(rules.char_class(actions))}"
    return (
        f"case when {has('remove_maximum', 'normalize_maximum')} then 'maximum' when {has('remove_strict', 'normalize_strict')} then 'strict'"
        f" when {has('remove_safe')} then 'safe' end"
    )


class TextFindings:
    """Rows of (codepoint, name, category, severity, action, position) for each mark of a text; none for a null one."""

    def eval(self, text: str) -> Iterator[tuple]:
        for m in MARK.finditer(text or ""):
            code = ord(m[0])
            rule = SPANS[bisect_right(STARTS, code) - 1][2]
            yield f"U+{code:04X}", rule.name, rule.category, rule.severity, rule.action, m.start()


text_findings = udtf(TextFindings, returnType="codepoint string, name string, category string, severity string, action string, position int")


def register(spark: SparkSession) -> None:
    """Makes sanitize_safe, sanitize_strict, sanitize_maximum, canonical_projection, finding_count, required_mode and the table function text_findings.

    All but the last are SQL expressions that Catalyst inlines.
    """
    made = {f"sanitize_{m}": ("string", sanitized(m)) for m in rules.MODES}
    made |= {f"clean_for_{m}": ("boolean", f"not text rlike {literal(rules.acted_on(m))}") for m in rules.MODES}
    made |= {
        "canonical_projection": ("string", sanitized("maximum")), "finding_count": ("bigint", f"cast(regexp_count(text, {literal(rules.ALL)}) as bigint)"), "required_mode": ("string", needed()),
    }
    for name, (kind, body) in made.items():
        spark.sql(f"create or replace temporary function {name}(text string) returns {kind} return {body}")
    spark.udtf.register("text_findings", text_findings)
