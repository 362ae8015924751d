"""Marked views of the driver's tables, which hold no mark themselves, for Spark and for SQL alike.

Each third text gets a mark before every space, one at its start and two at its
end; over the ids all 47 ranges of the rule table have their turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.rules import RULES

LAST_OF_RANGES = [b for r in RULES for _, b in r.ranges]


def marked(text: Column, key: Column) -> Column:
    """``text`` with the marks of its whole-number ``key``."""
    mark = F.element_at(F.array(*[F.lit(chr(c)) for c in LAST_OF_RANGES]), (F.pmod(key, F.lit(len(LAST_OF_RANGES))) + 1).cast("int"))
    return F.when(F.pmod(key, F.lit(3)) == 0, F.concat(mark, F.replace(text, F.lit(" "), F.concat(mark, F.lit(" "))), mark, mark)).otherwise(text)


def table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with its text column marked."""
    return df.withColumn(text, marked(F.col(text), F.col(key)))


def sql(text: str, key: str) -> str:
    """DuckDB's expression for ``marked``."""
    mark = f"chr(([{', '.join(map(str, LAST_OF_RANGES))}])[({key}) % {len(LAST_OF_RANGES)} + 1])"
    return f"case when ({key}) % 3 = 0 then {mark} || replace({text}, ' ', {mark} || ' ') || {mark} || {mark} else {text} end"
