"""Reports under SQL names: polymorphic table functions over texts, and views over tables of files.

``select * from analyze_text(table(docs))`` and ``select * from sanitize_text(table(docs), 'strict')``
give each row of ``docs`` back with the report behind its own columns, as the DataFrame functions of
``operators.findings`` do; a second or third argument names the text column. They see a
row at a time and need no shuffle.

What a file holds is decided by joins over its pieces, which no table function can make. So ``publish`` makes the
two file functions views over a table that the session knows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from glyphmill.functions import rules
from glyphmill.functions import text as tx
from glyphmill.operators import binaries, findings

STRING, LONG, INT, BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def fields(**kinds: T.DataType) -> T.StructType:
    """Columns of these names and types; in the Python that plans a table function no session parses schemas."""
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


FINDING = fields(codepoint=STRING, name=STRING, category=STRING, severity=STRING, action=STRING, count=LONG, first_positions=T.ArrayType(INT))
ANALYSIS = fields(
    rule_set_version=STRING, bytes=LONG, characters=LONG, finding_count=LONG, sha256=STRING, risk_counts=fields(**{s: LONG for s in rules.SEVERITIES}), findings=T.ArrayType(FINDING),
)
REPORT = fields(error_code=STRING, analysis=ANALYSIS)
SANITIZED = fields(
    error_code=STRING, output=STRING, mode=STRING, removed_count=LONG, normalized_count=LONG, change_count=LONG, changes_truncated=BOOL, verification_passed=BOOL, canonical_projection_unchanged=BOOL,
    verification_scope=STRING, probabilistic_watermark_status=STRING, status=STRING, next_mode=STRING, fully_clean=BOOL,
    changes=T.ArrayType(fields(source_index=INT, output_index=INT, before=STRING, after=STRING, kind=STRING)),
)


def place(table: AnalyzeArgument, column: AnalyzeArgument | None) -> int:
    """Where the text column is: the one named, or ``text``."""
    if not table.isTable or not isinstance(table.dataType, T.StructType):
        raise ValueError("the first argument must be table(...)")
    name = "text" if column is None else column.value
    names = table.dataType.names
    if name not in names or not isinstance(table.dataType[name].dataType, T.StringType):
        raise ValueError(f"no text column {name!r} in {names}")
    return names.index(name)


def widened(table: AnalyzeArgument, more: T.StructType) -> T.StructType:
    """The table's columns, those of the report behind them; an own column of the same name gives way."""
    return T.StructType([f for f in table.dataType.fields if f.name.lower() not in more.names] + more.fields)


def kept(row: Row, more: T.StructType) -> tuple:
    return tuple(v for n, v in zip(row.__fields__, row) if n.lower() not in more.names)


def error_of(text: str | None) -> str | None:
    return "text-too-large" if text is not None and len(text.encode()) > tx.TEXT_LIMIT else None


def sanitized(text: str, mode: str) -> str:
    """The text after all of a mode's changes."""
    out, at = [], 0
    for start, _, before, after, _ in findings.changes_of(text, mode, len(text)):
        out += [text[at:start], after]
        at = start + len(before)
    return "".join([*out, text[at:]])


class AnalyzeText:
    """Rows with error_code and analysis. Bytes that are no UTF-8 reach a table function as U+FFFD."""

    @staticmethod
    def analyze(table: AnalyzeArgument, text_column: AnalyzeArgument | None = None) -> AnalyzeResult:
        place(table, text_column)
        return AnalyzeResult(schema=widened(table, REPORT))

    def eval(self, row: Row, text_column: str = "text") -> Iterator[tuple]:
        text = row[text_column]
        error = error_of(text)
        report = None
        if text is not None and error is None:
            told = findings.findings_of(text, findings.MOST_POSITIONS)
            raw = text.encode()
            risks = tuple(sum(f[5] for f in told if f[3] == s) for s in rules.SEVERITIES)
            report = (rules.RULE_SET_VERSION, len(raw), len(text), sum(f[5] for f in told), hashlib.sha256(raw).hexdigest(), risks, [(f"U+{f[0]:04X}", *f[1:]) for f in told])
        yield (*kept(row, REPORT), error, report)


class SanitizeText:
    """Rows with the columns of ``findings.sanitize_text`` and the ledger's ``changes``."""

    @staticmethod
    def analyze(table: AnalyzeArgument, mode: AnalyzeArgument, text_column: AnalyzeArgument | None = None) -> AnalyzeResult:
        place(table, text_column)
        rules.check_mode(mode.value)
        return AnalyzeResult(schema=widened(table, SANITIZED))

    def eval(self, row: Row, mode: str, text_column: str = "text") -> Iterator[tuple]:
        text = row[text_column]
        error = error_of(text)
        scope, vendor = tx.SCOPES[mode], tx.VENDOR_STATUS
        if text is None or error:
            yield (*kept(row, SANITIZED), error, None, mode, *[None] * 6, scope, vendor, *[None] * 4)
            return
        told = findings.changes_of(text, mode, len(text))
        removed = sum(not c[3] for c in told)
        output = sanitized(text, mode)
        left = {f[4] for f in findings.findings_of(output, 0)}
        clean = not left & set(rules.ACTIONS[mode])
        needed = next((m for m in rules.MODES if left <= set(rules.ACTIONS[m])), None) if left else None
        status = "REVIEW" if not clean else "POLICY ONLY" if left else "CLEAN"
        same = sanitized(text, "maximum") == sanitized(output, "maximum")
        counts = (removed, len(told) - removed, len(told), len(told) > findings.MOST_CHANGES)
        yield (*kept(row, SANITIZED), error, output, mode, *counts, clean, same, scope, vendor, status, needed if clean and needed != mode else None, clean and not left, told[: findings.MOST_CHANGES])


def register(spark: SparkSession) -> None:
    """Makes the table functions analyze_text and sanitize_text known to a session."""
    spark.udtf.register("analyze_text", udtf(AnalyzeText))
    spark.udtf.register("sanitize_text", udtf(SanitizeText))


def publish(spark: SparkSession, files: str, id_col: str = "path", content_col: str = "content") -> None:
    """Views ``analyze_binary_<files>``, ``sanitize_binary_<files>`` and ``batch_status_<files>`` over a table of files.

    The first two have the columns of the functions in ``operators.binaries``. What a view
    tells of the files is worked out once, when it is made.
    """
    table = spark.table(files)
    name = files.rpartition(".")[2]
    binaries.analyze_binary(table, id_col, content_col).createOrReplaceTempView(f"analyze_binary_{name}")
    cleaned = binaries.sanitize_binary(table, id_col, content_col)
    cleaned.createOrReplaceTempView(f"sanitize_binary_{name}")
    binaries.batch_status(cleaned).createOrReplaceTempView(f"batch_status_{name}")
