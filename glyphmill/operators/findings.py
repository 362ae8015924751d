"""Findings, reports and change ledgers of a table of texts.

Counts come from expressions over the text alone. What is told mark by mark (groups
with their places, the ledger) is made in the row too, by Arrow functions that see
only texts with a mark, go over each once and hold the rows of a few texts at a time,
however many are in a batch. So nothing here shuffles, and rows that share an id stay texts of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import batched, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from glyphmill.functions import rules
from glyphmill.functions import text as tx
from glyphmill.sources.shared import bound_batches, map_batches

MOST_POSITIONS = 8
MOST_CHANGES = 4096


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k, mark, codepoint, gap and the rule's columns): a row for each mark, ``gap`` characters after the one before.

    ``id_col`` names a row: two rows of one id count as one text. Null texts and
    texts without a mark have no rows.
    """
    text = F.col(text_col)
    hit = docs.where(text.rlike(rules.ALL_FAST)).select(F.col(id_col), text.alias("_text"))
    pairs = F.arrays_zip(
        F.regexp_extract_all("_text", F.lit(rules.ALL_FAST), F.lit(0)).alias("mark"),
        F.transform(F.split("_text", rules.ALL_FAST, -1), F.length).alias("gap"),
    )
    each = hit.select(id_col, F.posexplode(pairs).alias("k", "pair")).where("pair.mark is not null")
    each = each.select(id_col, "k", "pair.mark", "pair.gap", F.ascii("pair.mark").alias("codepoint"))
    known = F.broadcast(rules.blocks(docs.sparkSession))  # under 800 rows, fixed by the rule table
    block = F.shiftright("codepoint", rules.BLOCK_BITS) == F.col("block")
    return each.join(known, block & F.col("codepoint").between(F.col("lo"), F.col("hi"))).drop("block", "lo", "hi")


FINDINGS = "codepoint int, name string, category string, severity string, action string, count long, first_positions array<int>"
CHANGES = "source_index int, output_index int, before string, after string, kind string"
MOST_ROWS = 8192


@lru_cache(maxsize=1)
def scanner() -> tuple[re.Pattern, list[int], list[rules.Rule]]:
    """A pattern for any mark, and the rules by the first code point of each of their ranges."""
    ranges = sorted((a, b, r) for r in rules.RULES for a, b in r.ranges)
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b, _ in ranges) + "]"), [a for a, _, _ in ranges], [r for _, _, r in ranges]


def rule_of(mark: str) -> rules.Rule:
    _, starts, known = scanner()
    return known[bisect_right(starts, ord(mark)) - 1]


def findings_of(text: str, positions: int) -> list[tuple]:
    """Fields of ``FINDINGS`` for each kind of mark in a text, by rising code point."""
    count: Counter[str] = Counter()
    first: dict[str, list[int]] = {}
    for m in scanner()[0].finditer(text):
        count[m[0]] += 1
        if count[m[0]] <= positions:
            first.setdefault(m[0], []).append(m.start())
    told = ((mark, rule_of(mark)) for mark in sorted(count))
    return [(ord(mark), r.name, r.category, r.severity, r.action, count[mark], first.get(mark, [])) for mark, r in told]


def changes_in(text: str, mode: str) -> Iterator[tuple]:
    """Fields of ``CHANGES`` for each mark that the mode acts on, by place, made as they are asked for."""
    grown = 0
    after: dict[str, str | None] = {}
    for m in scanner()[0].finditer(text):
        mark = m[0]
        if mark not in after:
            rule = rule_of(mark)
            written = rules.written(rule)
            after[mark] = None if rule.action not in rules.ACTIONS[mode] else written or (chr(ord(mark) - rules.FULL_WIDTH) if written == "" else "")
        new = after[mark]
        if new is None:
            continue
        yield m.start(), m.start() + grown, mark, new, "normalized" if new else "removed"
        grown += len(new) - 1


def changes_of(text: str, mode: str, most: int | None) -> list[tuple]:
    """The first ``most`` of a text's changes, or all of them for None."""
    return list(islice(changes_in(text, mode), most))


def found(text: Column, positions: int = MOST_POSITIONS) -> Column:
    """The findings of a text as an array of ``FINDINGS``; null for a text without a mark."""
    names = [f.name for f in StructType.fromDDL(FINDINGS)]

    @F.pandas_udf(f"array<struct<{FINDINGS}>>")
    def tell(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(names, x)) for x in findings_of(t, positions)] for t in texts], dtype=object)

    return tell(F.when(text.rlike(rules.ALL_FAST), text))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", positions: int = MOST_POSITIONS) -> DataFrame:
    """(id, codepoint, name, category, severity, action, count, first_positions): a row for each mark's kind in each text. No shuffle."""
    hit = docs.where(F.col(text_col).rlike(rules.ALL_FAST))
    return told(hit, id_col, text_col, lambda text: findings_of(text, positions), FINDINGS)


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, codepoint, position): a row for each mark and its place in code points from 0. No shuffle."""
    @F.pandas_udf("array<int>")
    def tell(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else np.fromiter((m.start() for m in scanner()[0].finditer(t)), np.int32) for t in texts], dtype=object)

    bound_batches(docs.sparkSession)
    hit = docs.where(F.col(text_col).rlike(rules.ALL_FAST)).select(F.col(id_col), F.col(text_col).alias("_text"), tell(F.col(text_col)).alias("_places"))
    # Four bytes a mark in the row; the characters themselves are found again side by side.
    marks_of = F.regexp_extract_all("_text", F.lit(rules.ALL_FAST), F.lit(0))
    each = hit.select(id_col, F.inline(F.arrays_zip(marks_of.alias("mark"), F.col("_places").alias("position"))))
    return each.select(id_col, F.ascii("mark").alias("codepoint"), "position")


def told(docs: DataFrame, id_col: str, text_col: str, tell: Callable[[str], Iterable[tuple]], fields: str) -> DataFrame:
    """The id of each text with the rows of ``fields`` that ``tell`` makes of it. Rows leave the task as they come, less than twice ``MOST_ROWS`` at a time, those of one text too."""
    hit = docs.select(F.col(id_col).alias("_0"), F.col(text_col).alias("_1"))
    rows = StructType.fromDDL(fields)
    schema = StructType([StructField("_0", hit.schema["_0"].dataType), *rows])
    types = [to_arrow_type(f.dataType) for f in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(types)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int32())), *map(pa.array, columns, types)], names=schema.names)

        for batch in batches:
            out: list[tuple] = []
            owners: list[int] = []
            for i, text in enumerate(batch.column(1)):
                for more in batched(tell(text.as_py()), MOST_ROWS):
                    out += more
                    owners += [i] * len(more)
                    if len(out) >= MOST_ROWS:
                        yield made()
                        out, owners = [], []
            yield made()

    return map_batches(hit, run, schema).withColumnRenamed("_0", docs.select(id_col).columns[0])


def ledger(docs: DataFrame, mode: str, id_col: str = "doc_id", text_col: str = "text", most: int | None = MOST_CHANGES) -> DataFrame:
    """(id, source_index, output_index, before, after, kind): the first ``most`` changes of each text, by place; all of them for None. No shuffle."""
    rules.check_mode(mode)
    hit = docs.where(F.col(text_col).rlike(rules.fast(rules.acted_on(mode))))
    return told(hit, id_col, text_col, lambda text: islice(changes_in(text, mode), most), CHANGES)


def counts(text: Column) -> list[Column]:
    """bytes, characters, finding_count and sha256 of a text."""
    return [
        F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("characters"), tx.finding_count(text).alias("finding_count"), F.sha2(text.cast("binary"), 256).alias("sha256"),
    ]


def analyze_text(docs: DataFrame, text_col: str = "text", limit: int = tx.TEXT_LIMIT) -> DataFrame:
    """``docs`` with an ``analysis`` struct: version, counts, risks and the findings by rising code point.

    A null text has a null report; a text beyond ``limit`` bytes or that is no
    UTF-8 has a null report and its ``error_code``. Texts without marks have an
    empty list of findings. No shuffle; rows may share an id.
    """
    bound_batches(docs.sparkSession)
    text = F.col(text_col)
    checked = docs.withColumn("error_code", tx.text_error(text, limit))
    good = F.when(F.col("error_code").isNull(), text)
    named = F.transform(found(good), lambda x: F.struct(tx.codepoint_name(x["codepoint"]).alias("codepoint"), *[x[c].alias(c) for c in ("name", "category", "severity", "action", "count", "first_positions")]))
    told = checked.withColumn("_findings", named)
    risks = F.struct(*[tx.severity_count(good, s).alias(s) for s in rules.SEVERITIES]).alias("risk_counts")
    none = F.array().cast(told.schema["_findings"].dataType)
    report = F.struct(F.lit(rules.RULE_SET_VERSION).alias("rule_set_version"), *counts(good), risks, F.coalesce("_findings", none).alias("findings"))
    return told.withColumn("analysis", F.when(good.isNotNull(), report)).drop("_findings")


def sanitize_text(docs: DataFrame, mode: str, text_col: str = "text", limit: int = tx.TEXT_LIMIT) -> DataFrame:
    """``docs`` with the sanitized text, its counts and its verification by a fresh scan. No shuffle.

    Adds error_code, output, mode, removed_count, normalized_count, change_count,
    changes_truncated, verification_passed, canonical_projection_unchanged,
    verification_scope, probabilistic_watermark_status, status, next_mode and
    fully_clean (whether no mark of any mode is left); all but the constants are null for a null text or one with an error. The
    changes themselves are in ``ledger``, findings in ``analyze_text``.
    """
    rules.check_mode(mode)
    docs = docs.withColumn("error_code", tx.text_error(F.col(text_col), limit))
    text = F.when(F.col("error_code").isNull(), F.col(text_col))
    out = docs.withColumn("_text", text).withColumn("output", tx.sanitize(F.col("_text"), mode))
    output = F.col("output")
    changes = F.col("removed_count") + F.col("normalized_count")
    return (
        out.withColumn("mode", F.lit(mode))
        .withColumn("removed_count", tx.removed_count(F.col("_text"), mode)).withColumn("normalized_count", tx.normalized_count(F.col("_text"), mode))
        .withColumn("change_count", changes).withColumn("changes_truncated", F.col("change_count") > MOST_CHANGES)
        .withColumn("verification_passed", tx.is_clean(output, mode))
        .withColumn("canonical_projection_unchanged", tx.projection(F.col("_text")) == tx.projection(output))
        .withColumn("verification_scope", F.lit(tx.SCOPES[mode])).withColumn("probabilistic_watermark_status", F.lit(tx.VENDOR_STATUS))
        .withColumn("status", tx.verify_status(output, mode)).withColumn("next_mode", tx.next_mode(output, mode))
        .withColumn("fully_clean", F.col("verification_passed") & ~output.rlike(rules.ALL_FAST)).drop("_text")
    )
