"""Whitespace collapse + lower-case (defined, unused by the scorer)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .skills import _col, whitespace_tokens


def preprocess_text(c) -> Column:
    return F.lower(F.array_join(whitespace_tokens(F.coalesce(_col(c), F.lit(""))), " "))
