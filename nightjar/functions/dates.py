"""Night-date parsing.

A night date arrives as text, as a date/timestamp, or as a spreadsheet
serial number (days since 1899-12-30). Text is never cast to a date
without a format: Spark would read '43831' as the year 43831. Accepted
text forms, tried in order (anything else is invalid):

* year, month, day with one separator of ``- / .`` (``2020-06-18``, ``2020/6/18``)
* ISO date-time with ``T`` or a space, optional seconds, fraction and
  offset; the wall date (first ten characters) is kept
* ``yyyyMMdd``
* month, day, year with one separator of ``- / .``; day first only if the first
  number can't be a month (``06-18-2020``, ``18.06.2020``; ``06.07.2020`` is June 7)
* English month name or its first three letters, before or after the day
  (``June 18, 2020``, ``18 Jun 2020``)
* five-digit serial text, only when ``serial_text=True``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from nightjar.constants import EXCEL_EPOCH
from nightjar.functions.text import nullify_missing_text, strip_ws

YEAR_FIRST_RE = r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})$"
ISO_DATETIME_RE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-5][0-9]"
    r"(:[0-5][0-9](\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
)
COMPACT_DATE_RE = r"^[0-9]{8}$"
YEAR_LAST_RE = r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})$"
NAME_FIRST_RE = r"^([A-Za-z]+)\.? ([0-9]{1,2}),? ([0-9]{4})$"
DAY_FIRST_RE = r"^([0-9]{1,2}) ([A-Za-z]+)\.?,? ([0-9]{4})$"
#: FIXED VALUES: English month names in order.
MONTH_NAMES = "january february march april may june july august september october november december".split()
SERIAL_TEXT_RE = r"^[0-9]{5}(\.[0-9]+)?$"


def _serial_to_date(days: Column) -> Column:
    return F.date_add(F.lit(EXCEL_EPOCH).cast("date"), F.floor(days).cast("int"))


def _date(year: Column, month: Column, day: Column) -> Column:
    """DATE of three numbers in text, NULL if there is no such day."""
    return F.try_to_date(F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _month_number(name: Column) -> Column:
    known = {form: i + 1 for i, month in enumerate(MONTH_NAMES) for form in (month, month[:3])} | {"sept": 9}
    return F.coalesce(*[F.when(F.lower(name).isin(*sorted({f for f, k in known.items() if k == i})), F.lit(str(i))) for i in range(1, 13)])


def _parse_text(text: Column, serial_text: bool) -> Column:
    s = strip_ws(nullify_missing_text(text))
    part = lambda pattern, n: F.regexp_extract(s, pattern, n)
    branches = (
        F.when(s.rlike(ISO_DATETIME_RE), _date(F.substring(s, 1, 4), F.substring(s, 6, 2), F.substring(s, 9, 2)))
        .when(s.rlike(COMPACT_DATE_RE), _date(F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))
        .when(s.rlike(YEAR_FIRST_RE), _date(*[part(YEAR_FIRST_RE, n) for n in (1, 3, 4)]))
        .when(s.rlike(YEAR_LAST_RE), F.coalesce(_date(*[part(YEAR_LAST_RE, n) for n in (4, 1, 3)]), _date(*[part(YEAR_LAST_RE, n) for n in (4, 3, 1)])))
        .when(s.rlike(NAME_FIRST_RE), _date(part(NAME_FIRST_RE, 3), _month_number(part(NAME_FIRST_RE, 1)), part(NAME_FIRST_RE, 2)))
        .when(s.rlike(DAY_FIRST_RE), _date(part(DAY_FIRST_RE, 3), _month_number(part(DAY_FIRST_RE, 2)), part(DAY_FIRST_RE, 1)))
    )
    if serial_text:
        branches = branches.when(s.rlike(SERIAL_TEXT_RE), _serial_to_date(s.try_cast("double")))
    return branches


def parse_night_date(c: Column, dtype: DataType, serial_text: bool = False) -> Column:
    """DATE or NULL; never raises on dirty input."""
    if isinstance(dtype, DateType):
        return c
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, NumericType):
        x = c.cast("double")
        return F.when(F.abs(x) < F.lit(float("inf")), _serial_to_date(x))
    return _parse_text(c if isinstance(dtype, StringType) else c.cast("string"), serial_text)


def iso_date_text(c: Column, dtype: DataType, serial_text: bool = False) -> Column:
    """ISO text of a parseable date, else the raw value as text."""
    parsed = parse_night_date(c, dtype, serial_text)
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), c.cast("string"))
