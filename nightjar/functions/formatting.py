"""Number printing.

``format_number`` with a plain pattern rounds the exact binary value
half-to-even, which is what ``'%.2f' % x`` does in Python; the Java-style
``format_string('%.2f')`` rounds the decimal text half-up instead
(0.25 -> 0.3, 2.675 -> 2.68).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_decimals(x: Column, digits: int) -> Column:
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", x, F.lit(pattern))
