"""All queries of the library but those of the ``llm`` subpackage, and their SQL."""

from __future__ import annotations

from glyphmill.plans import binary, jobs, text


def queries() -> dict[str, text.Query]:
    """Every query by name; each takes (spark, sf_dir)."""
    return text.QUERIES | binary.QUERIES | jobs.QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same columns and rows."""
    return text.SQL | binary.SQL | jobs.SQL
