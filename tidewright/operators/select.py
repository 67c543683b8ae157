"""Column selection by exclusion and by pattern."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def exclude(df: DataFrame, *columns: str) -> DataFrame:
    """All columns but the named ones, whatever their case; an unknown name is an error."""
    names = {c.lower() for c in df.columns}
    if unknown := [c for c in columns if c.lower() not in names]:
        raise ValueError(f"no such columns: {unknown}")
    gone = {c.lower() for c in columns}
    return df.select(*(df[f"`{c}`"] for c in df.columns if c.lower() not in gone))


def columns_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name has a match of the pattern anywhere, case-sensitive; none matching is an error."""
    found = [c for c in df.columns if re.search(pattern, c)]
    if not found:
        raise ValueError(f"no column matches {pattern!r}")
    return df.select(*(df[f"`{c}`"] for c in found))
