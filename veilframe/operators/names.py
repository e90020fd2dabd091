"""Names of columns that operators add and take away again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_prefix(df: DataFrame, base: str = "__p") -> str:
    """A beginning of column names that no column of the frame has."""
    while any(c.startswith(base) for c in df.columns):
        base += "_"
    return base
