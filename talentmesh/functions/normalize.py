"""Value normalisation of extracted rows (P4-P8), driven by the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TIMESTAMP_FORMAT, UNKNOWN
from .skills import _col


def timestamp_text(c) -> Column:
    """Timestamp -> 'yyyy-MM-dd HH:mm:ss' (sub-seconds dropped)."""
    return F.date_format(_col(c), TIMESTAMP_FORMAT)


# Private-use marks that stand in for U+FFFD while invalid bytes are removed.
_MARK, _REPLACEMENT = "\ue000", "\ufffd"


def bytes_text(c) -> Column:
    """P5: bytes -> UTF-8 text, invalid sequences dropped (decode 'ignore').

    Valid bytes are the text as it is.  Otherwise ``make_valid_utf8`` swaps
    each invalid sequence for U+FFFD, which is then removed; a genuine U+FFFD
    is told apart by a mark set before (``replace`` compares bytes, and a lead
    byte is never part of another sequence), and marks that were there before
    are escaped."""
    text = _col(c).cast("string")
    marked = F.replace(F.replace(text, F.lit(_MARK), F.lit(_MARK + "0")), F.lit(_REPLACEMENT), F.lit(_MARK + "1"))
    kept = F.replace(F.make_valid_utf8(marked), F.lit(_REPLACEMENT), F.lit(""))
    back = F.replace(F.replace(kept, F.lit(_MARK + "1"), F.lit(_REPLACEMENT)), F.lit(_MARK + "0"), F.lit(_MARK))
    return F.when(F.is_valid_utf8(text), text).otherwise(back)


def decimal_double(c) -> Column:
    """Decimal -> double."""
    return _col(c).cast("double")


def unknown_if_null(c) -> Column:
    """ISNULL(x, 'Unknown')."""
    return F.coalesce(_col(c), F.lit(UNKNOWN))


def normalize_row_values(df: DataFrame) -> DataFrame:
    """Convert timestamp/binary/decimal columns; leave the rest.

    ``date`` columns are not timestamps and pass through unchanged."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = timestamp_text(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = bytes_text(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = decimal_double(c)
        out.append(c.alias(f.name))
    return df.select(*out)
