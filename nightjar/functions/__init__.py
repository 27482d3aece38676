"""Column-level building blocks (all native Spark expressions)."""

from nightjar.functions.text import strip_ws, is_missing_text, nullify_missing_text
from nightjar.functions.numbers import (
    FINITE_NUMBER_RE, NONFINITE_NUMBER_RE, finite_or_null, lenient_number,
    raw_is_missing, strict_number,
)
from nightjar.functions.dates import parse_night_date, iso_date_text
from nightjar.functions.formatting import fixed_decimals

__all__ = [
    "strip_ws", "is_missing_text", "nullify_missing_text",
    "FINITE_NUMBER_RE", "NONFINITE_NUMBER_RE", "finite_or_null", "lenient_number",
    "raw_is_missing", "strict_number", "parse_night_date", "iso_date_text",
    "fixed_decimals",
]
