"""Scoring nights and assembling batch results.

One lineage, no shuffle: validation, features, model, attributions and the
14-column result are projections of the same rows. Each input row yields
exactly one output row; any failure is a value in ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nightjar import constants as K
from nightjar.functions.dates import parse_night_date
from nightjar.functions.numbers import finite_or_null, raw_is_missing, strict_number
from nightjar.functions.text import nullify_missing_text, strip_ws
from nightjar.operators.explain import main_label, with_factors
from nightjar.operators.features import engineer_features, feature_warnings
from nightjar.operators.lineage import filter_derived
from nightjar.operators.quality import annotate_quality, quality_gate

INVALID_PREDICTION = "Model returned an invalid efficiency prediction."
NOT_A_FLOAT = "could not convert string to float: "
_INF = float("inf")


def efficiency_band(pred: Column) -> Column:
    out = None
    for bound, label in K.EFFICIENCY_BANDS:
        out = (F.when(pred >= bound, F.lit(label)) if out is None
               else out.when(pred >= bound, F.lit(label)))
    return out.otherwise(F.lit(K.EFFICIENCY_BAND_LOWEST))


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    return F.when(~raw_is_missing(c, dtype), c.cast("string"))


def local_participant(df: DataFrame) -> Column:
    """F8: first non-null of participant_id, email (raw values)."""
    return F.coalesce(_text(df, "participant_id"), _text(df, "email"))


def display_identifier(df: DataFrame) -> Column:
    pid = strip_ws(_text(df, "participant_id"))
    email = strip_ws(_text(df, "email"))
    parts = F.split(email, "@", 2)
    masked = F.when(email.contains("@"),
                    F.concat(F.substring(F.get(parts, 0), 1, 2), F.lit("***@"), F.get(parts, 1))) \
        .otherwise(F.concat(F.substring(email, 1, 2), F.lit("***")))
    return F.when(pid != "", pid).when(email != "", masked)


def record_label(df: DataFrame, serial_text: bool = False) -> Column:
    """'id — ISO date — Row n' (missing parts skipped)."""
    if "date" in df.columns:
        parsed = parse_night_date(F.col("date"), df.schema["date"].dataType, serial_text)
    else:
        parsed = F.lit(None).cast("date")
    row = F.concat(F.lit("Row "), (F.col("source_index") + 2).cast("string"))
    return F.concat_ws(K.LABEL_SEPARATOR, display_identifier(df), F.date_format(parsed, "yyyy-MM-dd"), row)


def score_nights(nights: DataFrame, scorer, serial_text: bool = False, valid_only: bool = False) -> DataFrame:
    """Validated, featured, scored and explained nights (wide, one row per input).

    With ``valid_only`` rows that fail validation are left out before the features, so they never reach the model."""
    base = nights.select(
        "*",
        record_label(nights, serial_text).alias("record_label"),
        local_participant(nights).alias("_participant"),
        _text(nights, "date").alias("_raw_date"),
        (nullify_missing_text(_text(nights, "efficiency"))).alias("_raw_actual"),
    )
    gated = quality_gate(annotate_quality(base, serial_text)).withColumnRenamed("error", "_quality_error")
    if valid_only:
        gated = filter_derived(gated, F.col("_quality_error").isNull())
    featured = engineer_features(gated, serial_text)
    scored = scorer.transform(featured)
    actual_num = strict_number(F.col("_raw_actual"), StringType())
    model_error = F.when(F.col("_quality_error").isNull() & ~(F.abs(F.col("prediction")) < F.lit(_INF)),
                         F.lit(INVALID_PREDICTION))
    actual_error = F.when(F.col("_raw_actual").isNotNull() & actual_num.isNull(),
                          F.concat(F.lit(NOT_A_FLOAT + "'"), F.col("_raw_actual"), F.lit("'")))
    out = scored.select(
        "*",
        F.coalesce(F.col("_quality_error"), model_error, actual_error).alias("error"),
        finite_or_null(actual_num).alias("actual_efficiency"),
        feature_warnings(scored).alias("feature_warnings"),
        F.array(*[F.lit(w) for w in scorer.warnings]).cast("array<string>").alias("prediction_warnings"),
    )
    out = out.withColumn("all_warnings", F.concat("warnings", "feature_warnings", "prediction_warnings"))
    return with_factors(out)


def report_status(generate_reports: bool, fallback_only: bool) -> Column:
    if generate_reports and fallback_only:
        ok = K.REPORT_FALLBACK
    elif generate_reports:
        ok = K.REPORT_GENERATED
    else:
        ok = K.REPORT_NOT_REQUESTED
    return F.when(F.col("error").isNull(), F.lit(ok)).otherwise(F.lit(K.REPORT_FAILED))


def batch_results(scored: DataFrame, model_mae: float | None = None, generate_reports: bool = False,
                  fallback_only: bool = False) -> DataFrame:
    """exactly the 14 result columns, one row per input row."""
    ok = F.col("error").isNull()
    pred = F.when(ok, F.col("prediction"))
    return scored.select(
        (F.col("source_index") + 2).alias("source_row"),
        "record_label",
        F.col("_participant").alias("participant_id"),
        F.col("_raw_date").alias("date"),
        F.when(ok, F.col("quality")).otherwise(F.lit("Poor")).alias("data_quality"),
        pred.alias("predicted_efficiency"),
        F.col("actual_efficiency"),
        F.when(ok, F.abs(F.col("prediction") - F.col("actual_efficiency"))).alias("absolute_error"),
        F.when(ok, efficiency_band(F.col("prediction"))).alias("efficiency_band"),
        F.when(ok, F.lit(model_mae).cast("double")).alias("model_mae"),
        F.when(ok, main_label(F.col("factors_lowering"))).alias("main_lowering_factor"),
        F.when(ok, main_label(F.col("factors_increasing"))).alias("main_increasing_factor"),
        report_status(generate_reports, fallback_only).alias("report_status"),
        "error",
    )


def summary_aggregates() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("error").isNull()).alias("n_success"),
            F.count_if(F.col("error").isNotNull()).alias("n_failed"),
            F.avg(F.when(F.col("error").isNull(), F.col("predicted_efficiency"))).alias("mean_predicted_efficiency")]


def batch_summary(results: DataFrame) -> DataFrame:
    """counts and mean prediction in one aggregate."""
    return results.agg(*summary_aggregates())


def select_first_n(valid: DataFrame, n: int | None = None) -> DataFrame:
    """valid rows in source order, all of them or the first ``n``."""
    ordered = valid.orderBy("source_index")
    return ordered if n is None else ordered.limit(n)


def selection_warning(n_selected: int, n: int = K.MAX_BATCH_RECORDS) -> str | None:
    """what a caller that takes ``n`` rows has to tell when more were selected."""
    return K.SELECTION_CAPPED.format(selected=n_selected, limit=n) if n_selected > n else None


def select_by_label(rows: DataFrame, labels: DataFrame, label_col: str = "record_label") -> DataFrame:
    """rows whose label is in a chosen label table (semi join, no duplication)."""
    return rows.join(labels.select(F.col(label_col)), on=label_col, how="left_semi")


def passed(scored: DataFrame) -> DataFrame:
    """Rows that reached the model without any failure."""
    return filter_derived(scored, F.col("error").isNull())


def processing_errors(results: DataFrame) -> DataFrame:
    """K2: the error sheet."""
    return filter_derived(results, F.col("error").isNotNull()).select("source_row", "record_label", "error")


def input_preview(nights: DataFrame, n: int = K.MAX_BATCH_RECORDS) -> DataFrame:
    """K2: the first n input rows in source order (a top-n, not a full sort)."""
    return nights.orderBy("source_index").limit(n)
