"""Expressions that must be evaluated once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, fields: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its ``keep`` columns) plus the computed ``fields``.  They come
    out of a generator over a one-element array; filters on them stay above
    it, so no optimizer rule copies the expressions into a filter or a lambda
    and evaluates them again there."""
    kept = ["*"] if keep is None else [F.col(f"`{k}`") for k in keep]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))))
