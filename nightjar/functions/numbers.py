"""Numeric parsing of dirty cells.

Spark's own string->double cast is more permissive than a strict float
parser (it accepts suffixes such as ``12d`` or ``1f``), so every cast is
guarded by a regular expression first. Two flavours exist:

* ``strict_number`` keeps NaN / +-inf so that validation can say
  "must be finite";
* ``lenient_number`` turns anything non-numeric or non-finite into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType


FINITE_NUMBER_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NONFINITE_NUMBER_RE = r"^\s*[+-]?(?i:nan|inf|infinity)\s*$"
# Either of the two above, as one pattern (one regex evaluation per cell).
ANY_NUMBER_RE = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))\s*$"

_INF = float("inf")


def _as_text(c: Column, dtype: DataType) -> Column:
    return c if isinstance(dtype, StringType) else c.cast(StringType())


def finite_or_null(x: Column) -> Column:
    """NULL for NaN and +-inf (NaN compares greater than inf in Spark)."""
    return F.when(F.abs(x) < F.lit(_INF), x)


def raw_is_missing(c: Column, dtype: DataType) -> Column:
    """A cell counts as missing when NULL, or NaN in a floating column."""
    if isinstance(dtype, NumericType):
        return c.isNull() | F.isnan(c.cast("double"))
    return c.isNull()


def strict_number(c: Column, dtype: DataType) -> Column:
    """Double value as a strict float parser sees it (NaN/inf kept).

    NULL means "not numeric" (or missing; combine with ``raw_is_missing``).
    """
    if isinstance(dtype, NumericType):
        return F.when(~F.isnan(c.cast("double")), c.cast("double"))
    text = _as_text(c, dtype)
    # The guard admits only edge white space, which the cast itself trims.
    return F.when(text.rlike(ANY_NUMBER_RE), text.try_cast("double"))


def lenient_number_raw(c: Column, dtype: DataType) -> Column:
    """Lenient parse before the finiteness test (may still be +-inf on overflow).

    Missing-value spellings never match the number pattern, so no separate
    missing-text step is needed here.
    """
    if isinstance(dtype, NumericType):
        return c.cast("double")
    return F.when(_as_text(c, dtype).rlike(FINITE_NUMBER_RE), _as_text(c, dtype).try_cast("double"))


def lenient_number(c: Column, dtype: DataType) -> Column:
    """Missing text, non-numeric text and non-finite values all become NULL."""
    return finite_or_null(lenient_number_raw(c, dtype))
