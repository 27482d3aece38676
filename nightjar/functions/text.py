"""Text helpers: whitespace stripping and missing-text detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightjar.constants import MISSING_TEXT

# `trim` only removes spaces; strip every leading/trailing white-space char.
_EDGE_WS = r"^\s+|\s+$"


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_WS, "")


def is_missing_text(c: Column) -> Column:
    """True where a text cell is one of the missing-value spellings."""
    return F.lower(strip_ws(c)).isin(MISSING_TEXT)


def nullify_missing_text(c: Column) -> Column:
    return F.when(is_missing_text(c), F.lit(None)).otherwise(c)
