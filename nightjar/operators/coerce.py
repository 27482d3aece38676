"""Cleaning and coercion projections (row-local, no shuffle)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nightjar.constants import NUMERIC_INPUT_FIELDS, RAW_NUMERIC_COLUMNS
from nightjar.functions.dates import iso_date_text, parse_night_date
from nightjar.functions.numbers import finite_or_null, lenient_number, raw_is_missing, strict_number
from nightjar.functions.text import nullify_missing_text


def _q(name: str):
    return F.col(f"`{name}`")


def clean_text(df: DataFrame) -> DataFrame:
    """B1: missing-value spellings -> NULL in every text column."""
    return df.select(*[
        nullify_missing_text(_q(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else _q(f.name)
        for f in df.schema.fields
    ])


def clean_numeric(df: DataFrame, columns: Iterable[str] = RAW_NUMERIC_COLUMNS) -> DataFrame:
    """B1 + B2: text cleaned, selected columns coerced to finite doubles or NULL."""
    wanted = set(columns)
    cleaned = clean_text(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    return cleaned.select(*[
        lenient_number(_q(c), types[c]).alias(c) if c in wanted else _q(c)
        for c in cleaned.columns
    ])


def parse_dates(df: DataFrame, column: str = "date", out: str = "night_date",
                serial_text: bool = False) -> DataFrame:
    """DATE column ``out`` (NULL when absent or unparseable)."""
    if column not in df.columns:
        return df.withColumn(out, F.lit(None).cast("date"))
    return df.withColumn(out, parse_night_date(_q(column), df.schema[column].dataType, serial_text))


def prepare_rows(df: DataFrame, serial_text: bool = False) -> DataFrame:
    """The supported raw fields only, typed where convertible.

    ``date`` is ISO text when parseable, else the raw text. Each numeric
    field ``f`` becomes a finite double (or NULL) plus ``f_text`` holding the
    raw text where it is present but not a finite number, so that the
    validator can still report it. Identifiers and the target are dropped.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    if "source_index" in types:
        out.append(_q("source_index"))
    if "date" in types:
        missing = raw_is_missing(_q("date"), types["date"])
        out.append(F.when(~missing, iso_date_text(_q("date"), types["date"], serial_text)).alias("date"))
    else:
        out.append(F.lit(None).cast("string").alias("date"))
    for f in NUMERIC_INPUT_FIELDS:
        if f in types:
            missing = raw_is_missing(_q(f), types[f])
            value = finite_or_null(strict_number(_q(f), types[f]))
            out.append(F.when(~missing, value).alias(f))
            out.append(F.when(~missing & value.isNull(), _q(f).cast("string")).alias(f + "_text"))
        else:
            out.append(F.lit(None).cast("double").alias(f))
            out.append(F.lit(None).cast("string").alias(f + "_text"))
    return df.select(*out)
