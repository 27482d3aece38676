"""The query catalog: one Spark plan per inventory operator, keyed by name.

Each entry is ``(spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Spark functions read the driver's parquet tables and run the library
operators on the whole table; the presentation step only joins arrays,
formats dates and rounds floating values (``r9``) exactly like the oracle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators import coerce, features as feat, quality
from nightjar.operators import explain as X
from nightjar.operators import folds as FO
from nightjar.operators import impute as IM
from nightjar.operators import metrics as ME
from nightjar.operators import model as MO
from nightjar.operators import report as RE
from nightjar.operators import score as SC
from nightjar.operators.lineage import filter_derived
from nightjar.plans import oracle as O
from nightjar.plans import training as TR
from nightjar.plans.batch import fit_fixture_model
from nightjar.session import ensure_checkpoint_dir, tune_session
from nightjar.sources.nights import dealt, nights_from_events, normalise_columns, read_nights, read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        CATALOG[name] = (fn, sql)
        return fn
    return deco


# --- presentation helpers (mirrored by oracle.r9 / iso / concat_ws) ---------
def r9(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < F.lit(5e-10), F.lit(0.0)).otherwise(F.round(c, 9))


def joined(c) -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, "; ")


def iso(c) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune_session(spark)
    return nights_from_events(dealt(read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")))


def annotated(spark, sf_dir) -> DataFrame:
    return quality.annotate_quality(nights(spark, sf_dir))


def training(spark, sf_dir) -> DataFrame:
    return feat.prepare_training(nights(spark, sf_dir).drop("email"))


# ---------------------------------------------------------------- A: sources
@register("load_nights", f"{O.with_(O.NIGHTS)}select * from nights")
def q_load_nights(spark, sf_dir):
    return nights(spark, sf_dir)


MESSY_HEADERS = {
    "hr_average": " HR Average ", "rmssd": "HRV", "rem": "REM-Seconds", "deep": "Deep  Seconds",
    "total": "Total-Sleep Seconds", "breath_average": "Breathing_Rate", "hr_lowest": "Lowest HR",
    "onset_latency": "Onset-Latency", "participant_id": "Participant ID",
}


@register("normalise_columns", f"{O.with_(O.NIGHTS)}select * from nights")
def q_normalise_columns(spark, sf_dir):
    df = nights(spark, sf_dir)
    messy = df.toDF(*[MESSY_HEADERS.get(c, c) for c in df.columns])
    return normalise_columns(messy)


# ---------------------------------------------------------------- B: coercion
_clean_text_sql = ", ".join(f"{O.nullify(c)} as {c}" for c in O.NIGHT_COLUMNS)


@register("clean_text", f"{O.with_(O.NIGHTS)}select source_index, {_clean_text_sql} from nights")
def q_clean_text(spark, sf_dir):
    return coerce.clean_text(nights(spark, sf_dir))


_clean_num_sql = ", ".join(
    (f"{O.lenient_num(c)} as {c}" if c in K.RAW_NUMERIC_COLUMNS else f"{O.nullify(c)} as {c}")
    for c in O.NIGHT_COLUMNS)


@register("clean_numeric", f"{O.with_(O.NIGHTS)}select source_index, {_clean_num_sql} from nights")
def q_clean_numeric(spark, sf_dir):
    return coerce.clean_numeric(nights(spark, sf_dir))


@register("parse_dates", f"{O.with_(O.NIGHTS)}select source_index, date, {O.iso(O.parse_date('date'))} as night_date, "
                         f"cast(isodow({O.parse_date('date')}) - 1 as double) as weekday from nights")
def q_parse_dates(spark, sf_dir):
    df = coerce.parse_dates(nights(spark, sf_dir))
    return df.select("source_index", "date", iso("night_date").alias("night_date"),
                     F.weekday("night_date").cast("double").alias("weekday"))


def _prepare_sql() -> str:
    cols = [f"case when date is not null then coalesce({O.iso(O.parse_date('date'))}, date) end as date"]
    for f in K.NUMERIC_INPUT_FIELDS:
        v = f"(case when isfinite({O.strict_num(f)}) then {O.strict_num(f)} end)"
        cols.append(f"case when {f} is not null then {v} end as {f}")
        cols.append(f"case when {f} is not null and {v} is null then {f} end as {f}_text")
    return f"{O.with_(O.NIGHTS)}select source_index, {', '.join(cols)} from nights"


@register("prepare_rows", _prepare_sql())
def q_prepare_rows(spark, sf_dir):
    return coerce.prepare_rows(nights(spark, sf_dir))


# ---------------------------------------------------------------- C: quality
_Q = O.with_(O.NIGHTS, *O.quality_ctes())


@register("dq_errors", f"{_Q}select source_index, errors_text as errors, "
                       f"cast(coalesce(len(string_split(nullif(errors_text, ''), '; ')), 0) as integer) as n_errors from q")
def q_dq_errors(spark, sf_dir):
    return annotated(spark, sf_dir).select("source_index", joined("errors").alias("errors"),
                                           F.size("errors").alias("n_errors"))


@register("dq_warnings", f"{_Q}select source_index, warnings_text as warnings, "
                         f"missing_optional_text as missing_optional_fields from q")
def q_dq_warnings(spark, sf_dir):
    return annotated(spark, sf_dir).select("source_index", joined("warnings").alias("warnings"),
                                           joined("missing_optional_fields").alias("missing_optional_fields"))


@register("dq_quality", f"{_Q}select source_index, quality from q")
def q_dq_quality(spark, sf_dir):
    return annotated(spark, sf_dir).select("source_index", "quality")


@register("dq_gate", f"{_Q}select source_index, quality, error is null as passes, error from q")
def q_dq_gate(spark, sf_dir):
    gated = quality.quality_gate(annotated(spark, sf_dir))
    return gated.select("source_index", "quality", F.col("error").isNull().alias("passes"), "error")


def _schema_report_sql() -> str:
    cols = quality.schema_columns(["source_index"] + O.NIGHT_COLUMNS)
    warn = [O.lit(K.SCHEMA_HAS_TARGET),
            f"case when n_error_rows > 0 then {O.lit(K.SCHEMA_ROW_ERRORS.split('{n}')[0])} || "
            f"cast(n_error_rows as varchar) || {O.lit(K.SCHEMA_ROW_ERRORS.split('{n}')[1])} end"]
    errs = [f"case when n_rows = 0 then {O.lit(K.SCHEMA_EMPTY)} end",
            f"case when n_valid_rows = 0 and n_rows > 0 then {O.lit(K.SCHEMA_NO_VALID)} end"]
    return (f"{_Q}, c as (select count(*) as n_rows, count(*) filter (where errors_text = '') as n_valid_rows, "
            f"count(*) filter (where errors_text <> '') as n_error_rows from q), "
            f"r as (select *, concat_ws('; ', {', '.join(errs)}) as errors, concat_ws('; ', {', '.join(warn)}) as warnings from c) "
            f"select n_rows, n_valid_rows, n_error_rows, errors, warnings, "
            f"{O.lit('; '.join(cols['detected']))} as detected_columns, "
            f"{O.lit('; '.join(cols['missing']))} as missing_required_columns, "
            f"{O.lit('; '.join(cols['optional_present']))} as optional_columns_present, "
            f"{O.lit('; '.join(cols['ignored']))} as ignored_columns, "
            f"case when errors <> '' then {O.lit(K.STATE_BLOCKED)} when warnings <> '' then {O.lit(K.STATE_WARN)} "
            f"else {O.lit(K.STATE_READY)} end as state from r")


@register("schema_report", _schema_report_sql())
def q_schema_report(spark, sf_dir):
    rep = quality.validate_schema(nights(spark, sf_dir))
    return rep.select("n_rows", "n_valid_rows", "n_error_rows", joined("errors").alias("errors"),
                      joined("warnings").alias("warnings"),
                      *[joined(c).alias(c) for c in ("detected_columns", "missing_required_columns",
                                                     "optional_columns_present", "ignored_columns")],
                      "state")


@register("valid_rows", f"{_Q}select source_index, quality from q where errors_text = ''")
def q_valid_rows(spark, sf_dir):
    return quality.valid_rows(annotated(spark, sf_dir)).select("source_index", "quality")


@register("row_errors", f"{_Q}select source_index, source_index + 2 as source_row, errors_text as errors "
                        f"from q where errors_text <> ''")
def q_row_errors(spark, sf_dir):
    return quality.row_errors(annotated(spark, sf_dir)).select(
        "source_index", "source_row", joined("errors").alias("errors"))


# ---------------------------------------------------------------- D: features
_F = O.with_(O.NIGHTS, *O.features_ctes())


@register("features", f"{_F}select source_index, {', '.join(O.r9(f + '_f') + ' as ' + f for f in K.MODEL_FEATURES)} from feat")
def q_features(spark, sf_dir):
    eng = feat.engineer_features(nights(spark, sf_dir))
    return eng.select("source_index", *[r9(f).alias(f) for f in K.MODEL_FEATURES])


_fw = ", ".join(f"case when {f}_f is null then {O.lit(K.WARN_FEATURE_IMPUTED.format(feature=f))} end"
                for f in K.MODEL_FEATURES)


@register("feature_warnings", f"{_F}select source_index, concat_ws('; ', {_fw}) as warnings from feat")
def q_feature_warnings(spark, sf_dir):
    eng = feat.engineer_features(nights(spark, sf_dir))
    return eng.select("source_index", joined(feat.feature_warnings(eng)).alias("warnings"))


def _display_sql() -> str:
    cols = [f"coalesce({O.iso('feat.night_date')}, feat.date) as date"]
    cols += [f"{O.r9('feat.' + src + '_f')} as {name}" for name, src in K.DISPLAY_MEASUREMENTS]
    return (O.with_(O.NIGHTS, *O.quality_ctes(), *O.features_ctes())
            + f"select feat.source_index, {', '.join(cols)} from feat join q using (source_index) where q.error is null")


@register("display_measurements", _display_sql())
def q_display_measurements(spark, sf_dir):
    gated = filter_derived(quality.quality_gate(annotated(spark, sf_dir)), F.col("error").isNull())
    eng = feat.engineer_features(gated)
    cols = feat.display_measurements(eng, nights(spark, sf_dir).schema["date"].dataType)
    return eng.select("source_index", *cols).select(
        "source_index", "date", *[r9(name).alias(name) for name, _ in K.DISPLAY_MEASUREMENTS])


_T = O.with_(O.NIGHTS, *O.training_ctes())


@register("training_set", f"{_T}select source_index, participant_id, {O.iso('date')} as date, "
                          f"{', '.join(O.r9(f) + ' as ' + f for f in K.MODEL_FEATURES)}, efficiency from train")
def q_training_set(spark, sf_dir):
    t = training(spark, sf_dir)
    return t.select("source_index", "participant_id", iso("date").alias("date"),
                    *[r9(f).alias(f) for f in K.MODEL_FEATURES], "efficiency")


# ---------------------------------------------------------------- presentation
def present(df: DataFrame, doubles: list[str]) -> DataFrame:
    """Round the listed double columns with ``r9`` (same as the oracle)."""
    return df.select(*[r9(c).alias(c) if c in doubles else F.col(c) for c in df.columns])


def present_sql(inner: str, columns: list[str], doubles: list[str]) -> str:
    cols = ", ".join(f"{O.r9(c)} as {c}" if c in doubles else c for c in columns)
    return f"select {cols} from (\n{inner}\n) t"


def both(name: str, columns: list[str], doubles: list[str], inner_sql: str | None):
    """Register a query whose double columns are presented with r9 on both sides."""
    sql = present_sql(inner_sql, columns, doubles) if inner_sql is not None else None

    def deco(fn):
        def wrapped(spark, sf_dir):
            out = fn(spark, sf_dir)
            return present(out.select(*columns), doubles)
        wrapped.__name__ = fn.__name__
        CATALOG[name] = (wrapped, sql)
        return wrapped
    return deco


# ---------------------------------------------------------------- E: folds, medians, CV

SPLITS = K.DEFAULT_SPLITS
_CV = [O.NIGHTS, *O.training_ctes(), *O.oof_ctes(SPLITS)]


def cv(spark, sf_dir) -> TR.CVResult:
    return TR.cross_validate_linear(training(spark, sf_dir), SPLITS)


@both("participant_folds", ["participant_id", "n_rows", "fold"], [],
      O.with_(*_CV) + "select participant_id, n_rows, fold from folds")
def q_participant_folds(spark, sf_dir):
    return FO.participant_folds(training(spark, sf_dir), SPLITS)


def folded(spark, sf_dir) -> DataFrame:
    return TR.assign(TR.checkpointed(training(spark, sf_dir), "train"), SPLITS)[1]


@both("fold_overlap", ["fold", "n_participants", "participant_overlap_count"], [],
      O.with_(*_CV, *O.fold_metric_ctes()) + "select fold, n_participants, participant_overlap_count from ov")
def q_fold_overlap(spark, sf_dir):
    return FO.fold_overlap(folded(spark, sf_dir))


@both("fold_medians", ["fold", "feature", "median", "n_values"], ["median"],
      O.with_(*_CV) + "select fold, feature, median, n_values from med")
def q_fold_medians(spark, sf_dir):
    return IM.fold_medians(folded(spark, sf_dir), SPLITS)


_IMP = ["source_index", "fold", *K.MODEL_FEATURES]


@both("impute", _IMP, list(K.MODEL_FEATURES), O.with_(*_CV) + f"select {', '.join(_IMP)} from imp")
def q_impute(spark, sf_dir):
    wf = TR.checkpointed(folded(spark, sf_dir), "train_folds")
    return IM.impute_by_fold(wf, IM.fold_medians(wf, SPLITS))


_OOF = ["source_index", "participant_id", "date", "actual_efficiency", "predicted_efficiency",
        "absolute_error", "fold"]


@both("oof_predictions", _OOF, ["actual_efficiency", "predicted_efficiency", "absolute_error"],
      O.with_(*_CV) + "select source_index, participant_id, strftime(date, '%Y-%m-%d') as date, "
      "actual_efficiency, predicted_efficiency, absolute_error, fold from oof")
def q_oof_predictions(spark, sf_dir):
    return cv(spark, sf_dir).predictions.withColumn("date", iso("date"))


_FM = ["fold", *ME.METRIC_NAMES, "number_of_rows", "number_of_participants", "mean_actual_efficiency",
       "mean_predicted_efficiency", "participant_overlap_count"]
_FM_D = [*ME.METRIC_NAMES, "mean_actual_efficiency", "mean_predicted_efficiency"]


@both("fold_metrics", _FM, _FM_D, O.with_(*_CV, *O.fold_metric_ctes()) + f"select {', '.join(_FM)} from fmx")
def q_fold_metrics(spark, sf_dir):
    return cv(spark, sf_dir).fold_metrics()


@both("spearman", ["fold", "spearman_correlation"], ["spearman_correlation"],
      O.with_(*_CV, *O.spearman_ctes()) + "select fold, spearman_correlation from sp")
def q_spearman(spark, sf_dir):
    return cv(spark, sf_dir).spearman()


_SUM_STATS = [f"{m}_{s}" for m in ME.METRIC_NAMES for s in ("mean", "std")]
_SUM = [*ME.METRIC_NAMES, "number_of_rows", "number_of_participants", "mean_actual_efficiency",
        "mean_predicted_efficiency", *_SUM_STATS, "validation", "n_splits"]


def _cv_summary_sql() -> str:
    stats = ", ".join(f"{agg}({m}) as {m}_{s}" for m in ME.METRIC_NAMES
                      for agg, s in (("avg", "mean"), ("stddev_pop", "std")))
    return O.with_(*_CV, *O.fold_metric_ctes(),
                   f"ovr as (select {O.metric_aggs()} from oof)",
                   f"acr as (select {stats} from fmx)") + (
        f"select ovr.*, (select spearman_correlation from sp where fold = 0) as spearman_correlation, acr.*, "
        f"{O.lit(K.VALIDATION_NAME)} as validation, {SPLITS} as n_splits from ovr cross join acr")


@both("cv_summary", _SUM, [*_FM_D, *_SUM_STATS], _cv_summary_sql())
def q_cv_summary(spark, sf_dir):
    return cv(spark, sf_dir).summary()


_RES = ["source_index", "actual_efficiency", "predicted_efficiency", "residual", "axis_min", "axis_max"]


@both("residuals", _RES, _RES[1:], O.with_(*_CV) + (
      "select source_index, actual_efficiency, predicted_efficiency, actual_efficiency - predicted_efficiency "
      "as residual, (select least(min(actual_efficiency), min(predicted_efficiency)) from oof) as axis_min, "
      "(select greatest(max(actual_efficiency), max(predicted_efficiency)) from oof) as axis_max from oof"))
def q_residuals(spark, sf_dir):
    return ME.residuals(cv(spark, sf_dir).predictions)


def _histogram_sql(bins: int = K.HISTOGRAM_BINS) -> str:
    edge = ("(case when {i} = {b} then hi else cast({i} as double) * ((hi - lo) / {bf}) + lo end)")
    e = lambda i: edge.format(i=i, b=bins, bf=float(bins))
    return O.with_(*_CV,
                   "r0 as (select min(absolute_error) as a, max(absolute_error) as z from oof)",
                   "rg as (select case when a = z then a - 0.5 else a end as lo, case when a = z then z + 0.5 else z end as hi from r0)",
                   f"i0 as (select o.absolute_error as x, lo, hi, cast(floor((o.absolute_error - lo) * ({float(bins)} / (hi - lo))) as bigint) as i from oof o cross join rg where o.absolute_error is not null)",
                   f"i1 as (select x, lo, hi, case when i = {bins} then {bins - 1} else i end as i from i0)",
                   f"i2 as (select x, lo, hi, case when x < {e('i')} then i - 1 else i end as i from i1)",
                   f"i3 as (select case when x >= {e('(i + 1)')} and i <> {bins - 1} then i + 1 else i end as i from i2)",
                   "cnt as (select i, count(*) as n from i3 group by i)",
                   f"gr as (select cast(unnest(range(0, {bins})) as integer) as bin)") + (
        f"select gr.bin, {e('gr.bin').replace('hi', 'rg.hi').replace('lo', 'rg.lo')} as bin_start, "
        f"{e('(gr.bin + 1)').replace('hi', 'rg.hi').replace('lo', 'rg.lo')} as bin_end, "
        "coalesce(cnt.n, 0) as count from gr cross join rg left join cnt on cnt.i = gr.bin")


@both("error_histogram", ["bin", "bin_start", "bin_end", "count"], ["bin_start", "bin_end"], _histogram_sql())
def q_error_histogram(spark, sf_dir):
    return ME.error_histogram(cv(spark, sf_dir).predictions)


# ---------------------------------------------------------------- F: scoring
def scored(spark, sf_dir, with_metrics: bool = False):
    n = nights(spark, sf_dir)
    model = fit_fixture_model(n, SPLITS, with_metrics=with_metrics)
    return SC.score_nights(n, model), model


def passed(df: DataFrame) -> DataFrame:
    return SC.passed(df)


_BATCH = O.batch_ctes(with_mae=False)
_BATCH_MAE = O.batch_ctes(with_mae=True)


@both("score_linear", ["source_index", "predicted_efficiency", "base_value"], ["predicted_efficiency", "base_value"],
      O.with_(*_BATCH) + "select source_index, pred as predicted_efficiency, 85.0 as base_value from sc where err is null")
def q_score_linear(spark, sf_dir):
    s, _ = scored(spark, sf_dir)
    return passed(s).select("source_index", F.col("prediction").alias("predicted_efficiency"), "base_value")


@both("efficiency_band", ["source_index", "predicted_efficiency", "efficiency_band"], ["predicted_efficiency"],
      O.with_(*_BATCH) + f"select source_index, pred as predicted_efficiency, {O.band_sql('pred')} as efficiency_band "
      "from sc where err is null")
def q_efficiency_band(spark, sf_dir):
    s, _ = scored(spark, sf_dir)
    return passed(s).select("source_index", F.col("prediction").alias("predicted_efficiency"),
                            SC.efficiency_band(F.col("prediction")).alias("efficiency_band"))


_ATT = ["source_index", "base_value", "predicted_efficiency", *[MO.shap_col(f) for f in K.MODEL_FEATURES]]


@both("attributions_linear", _ATT, _ATT[1:],
      O.with_(*_BATCH) + "select source_index, 85.0 as base_value, pred as predicted_efficiency, "
      + ", ".join(f"shap_{f}" for f in K.MODEL_FEATURES) + " from sc where err is null")
def q_attributions_linear(spark, sf_dir):
    s, _ = scored(spark, sf_dir)
    return passed(s).withColumn("predicted_efficiency", F.col("prediction"))


_LONG = ["source_index", "feature_position", "feature", "display_name", "feature_value", "shap_value"]


@both("attribution_long", _LONG, ["feature_value", "shap_value"],
      O.with_(*_BATCH) + "select fl.source_index, pos as feature_position, feature, display_name, feature_value, "
      "shap_value from fl join sc using (source_index) where sc.err is null")
def q_attribution_long(spark, sf_dir):
    s, _ = scored(spark, sf_dir)
    return X.attribution_long(passed(s))


_TOP = ["source_index", "factor_rank", "feature", "display_name", "shap_value", "direction"]


@both("top_factors", _TOP, ["shap_value"],
      O.with_(*_BATCH) + "select rk.source_index, rnk as factor_rank, feature, display_name, shap_value, "
      "case when shap_value < 0 then 'lowering' else 'increasing' end as direction from rk join sc using (source_index) "
      "where sc.err is null and rnk <= 5 and shap_value <> 0")
def q_top_factors(spark, sf_dir):
    s, _ = scored(spark, sf_dir)
    top = passed(s).select("source_index", F.posexplode(X.top_factors(F.col("factors"))).alias("p", "x"))
    return top.filter(F.col("x.shap_value") != 0).select(
        "source_index", (F.col("p") + 1).alias("factor_rank"), F.col("x.feature").alias("feature"),
        F.col("x.display_name").alias("display_name"), F.col("x.shap_value").alias("shap_value"),
        F.when(F.col("x.shap_value") < 0, F.lit("lowering")).otherwise(F.lit("increasing")).alias("direction"))


_CHART = ["source_index", "bar_rank", "display_name", "shap_value", "sign"]


@both("contribution_chart", _CHART, ["shap_value"],
      O.with_(*_BATCH, "tk as (select rk.* from rk join sc using (source_index) where sc.err is null and rnk <= 5 "
              "and shap_value <> 0), ord as (select *, row_number() over (partition by source_index order by "
              "abs(shap_value) desc, case when shap_value < 0 then 0 else 1 end, rnk) as bar_rank from tk)")
      + "select source_index, bar_rank, display_name, shap_value, case when shap_value >= 0 then 'positive' "
        "else 'negative' end as sign from ord where bar_rank <= 8")
def q_contribution_chart(spark, sf_dir):
    s, _ = scored(spark, sf_dir)
    chart = passed(s).select("source_index", F.posexplode(
        X.contribution_chart(F.col("factors_lowering"), F.col("factors_increasing"))).alias("p", "x"))
    return chart.select("source_index", (F.col("p") + 1).alias("bar_rank"), F.col("x.display_name").alias("display_name"),
                        F.col("x.shap_value").alias("shap_value"), F.col("x.sign").alias("sign"))


_PE = ["source_index", "predicted_efficiency", "actual_efficiency", "prediction_error", "absolute_error"]


@both("prediction_error", _PE, _PE[1:],
      O.with_(*_BATCH) + "select source_index, pred as predicted_efficiency, actual as actual_efficiency, "
      "pred - actual as prediction_error, abs(pred - actual) as absolute_error from sc where err is null and actual is not null")
def q_prediction_error(spark, sf_dir):
    s, _ = scored(spark, sf_dir)
    ok = filter_derived(s, F.col("error").isNull() & F.col("actual_efficiency").isNotNull())
    return ok.select("source_index", F.col("prediction").alias("predicted_efficiency"), "actual_efficiency",
                     (F.col("prediction") - F.col("actual_efficiency")).alias("prediction_error"),
                     F.abs(F.col("prediction") - F.col("actual_efficiency")).alias("absolute_error"))


@both("record_labels", ["source_index", "participant_id", "record_label"], [],
      f"{O.with_(O.NIGHTS)}select source_index, coalesce(participant_id, email) as participant_id, "
      f"{O.label_sql()} as record_label from nights")
def q_record_labels(spark, sf_dir):
    n = nights(spark, sf_dir)
    return n.select("source_index", SC.local_participant(n).alias("participant_id"),
                    SC.record_label(n).alias("record_label"))


_BR_D = ["predicted_efficiency", "actual_efficiency", "absolute_error", "model_mae"]


@both("batch_results", list(K.BATCH_RESULT_COLUMNS), _BR_D, O.batch_results_sql(with_mae=True))
def q_batch_results(spark, sf_dir):
    s, model = scored(spark, sf_dir, with_metrics=True)
    return SC.batch_results(s, model.model_mae)


@both("batch_summary", ["n_rows", "n_success", "n_failed", "mean_predicted_efficiency"], ["mean_predicted_efficiency"],
      "select count(*) as n_rows, count(*) filter (where error is null) as n_success, count(*) filter (where error is not null) "
      "as n_failed, avg(predicted_efficiency) filter (where error is null) as mean_predicted_efficiency from ("
      + O.batch_results_sql(with_mae=False) + ") b")
def q_batch_summary(spark, sf_dir):
    s, model = scored(spark, sf_dir)
    return SC.batch_summary(SC.batch_results(s, model.model_mae))


@both("select_first_n", ["source_index", "record_label"], [],
      O.with_(O.NIGHTS, *O.quality_ctes()) + f"select source_index, {O.label_sql()} as record_label from q "
      f"where errors_text = '' order by source_index limit {K.MAX_BATCH_RECORDS}")
def q_select_first_n(spark, sf_dir):
    n = nights(spark, sf_dir)
    valid = quality.valid_rows(quality.annotate_quality(n.withColumn("record_label", SC.record_label(n))))
    return SC.select_first_n(valid.select("source_index", "record_label"), K.MAX_BATCH_RECORDS)


@both("select_by_label", ["source_index", "record_label", "quality"], [],
      O.with_(O.NIGHTS, *O.quality_ctes(), f"lb as (select source_index, {O.label_sql()} as record_label, quality, errors_text from q)")
      + "select source_index, record_label, quality from lb where errors_text = '' and record_label in "
        "(select record_label from lb where quality = 'Limited')")
def q_select_by_label(spark, sf_dir):
    n = nights(spark, sf_dir)
    ann = quality.annotate_quality(n.withColumn("record_label", SC.record_label(n)))
    chosen = filter_derived(ann, F.col("quality") == "Limited").select("record_label")
    return SC.select_by_label(quality.valid_rows(ann), chosen).select("source_index", "record_label", "quality")


@both("processing_errors", ["source_row", "record_label", "error"], [],
      "select source_row, record_label, error from (" + O.batch_results_sql(with_mae=False) + ") b where error is not null")
def q_processing_errors(spark, sf_dir):
    s, model = scored(spark, sf_dir)
    return SC.processing_errors(SC.batch_results(s, model.model_mae))


@both("input_preview", ["source_index", *O.NIGHT_COLUMNS], [],
      f"{O.with_(O.NIGHTS)}select * from nights order by source_index limit {K.MAX_BATCH_RECORDS}")
def q_input_preview(spark, sf_dir):
    return SC.input_preview(nights(spark, sf_dir))


@both("all_warnings", ["source_index", "warnings", "n_warnings"], [],
      O.with_(*_BATCH) + "select source_index, all_warnings_text as warnings, "
      "cast(n_warnings_q + n_fw as integer) as n_warnings from sc where err is null")
def q_all_warnings(spark, sf_dir):
    s, _ = scored(spark, sf_dir)
    return passed(s).select("source_index", joined("all_warnings").alias("warnings"),
                            F.size("all_warnings").alias("n_warnings"))


@both("reports", ["source_index", "report"], [], O.report_sql())
def q_reports(spark, sf_dir):
    s, model = scored(spark, sf_dir, with_metrics=True)
    return passed(RE.with_reports(s, model.model_mae))


_PAY = ["source_index", "predicted_efficiency_percent", "efficiency_band", "model_mae_percent", "measurement_date",
        "rem_sleep_percent", "factors_lowering", "factors_increasing", "data_quality_warnings"]


@both("report_payload", _PAY, ["predicted_efficiency_percent", "model_mae_percent", "rem_sleep_percent"], O.payload_sql())
def q_report_payload(spark, sf_dir):
    s, model = scored(spark, sf_dir, with_metrics=True)
    doc = passed(s).select("source_index", F.to_json(RE.report_payload(s, model.model_mae)).alias("j"))
    schema = ("predicted_efficiency_percent double, efficiency_band string, model_mae_percent double, "
              "verified_measurements struct<date: string, rem_sleep_percent: double>, "
              "factors_lowering_prediction array<struct<display_name: string>>, "
              "factors_increasing_prediction array<struct<display_name: string>>, "
              "data_quality_warnings array<string>")
    p = doc.select("source_index", F.from_json("j", schema).alias("p"))
    names = lambda c: F.array_join(F.transform(F.col(c), lambda x: x["display_name"]), "; ")
    return p.select("source_index", "p.predicted_efficiency_percent", "p.efficiency_band", "p.model_mae_percent",
                    F.col("p.verified_measurements.date").alias("measurement_date"),
                    F.col("p.verified_measurements.rem_sleep_percent").alias("rem_sleep_percent"),
                    names("p.factors_lowering_prediction").alias("factors_lowering"),
                    names("p.factors_increasing_prediction").alias("factors_increasing"),
                    joined("p.data_quality_warnings").alias("data_quality_warnings"))


def single_result(s: DataFrame, model) -> DataFrame:
    """The single-night result document (with identifiers that the export must drop)."""
    return s.select(
        "source_index",
        F.sha2(F.coalesce(F.col("participant_id"), F.lit("")), 256).alias("participant_uid"),
        F.struct("quality", "warnings", "errors", "missing_optional_fields",
                 F.col("email").alias("participant_email")).alias("data_quality"),
        RE.display_struct().alias("display_measurements"),
        F.struct(*[F.col(f) for f in K.MODEL_FEATURES]).alias("model_features"),
        F.col("prediction").alias("predicted_efficiency_percent"),
        SC.efficiency_band(F.col("prediction")).alias("efficiency_band"),
        F.lit(model.model_mae).cast("double").alias("model_mae_percent"),
        "base_value",
        F.col("factors_lowering").alias("factors_lowering_prediction"),
        F.col("factors_increasing").alias("factors_increasing_prediction"),
    )


_RJ = ["source_index", "keys", "quality", "predicted_efficiency_percent", "has_sensitive"]
_RJ_KEYS = ",".join(sorted(["data_quality", "display_measurements", "model_features", "predicted_efficiency_percent",
                            "efficiency_band", "model_mae_percent", "base_value", "factors_lowering_prediction",
                            "factors_increasing_prediction", "source_index"]))


@both("result_json", _RJ, ["predicted_efficiency_percent"],
      O.with_(*O.batch_ctes(with_mae=False)) + f"select source_index, '{_RJ_KEYS}' as keys, quality, "
      "pred as predicted_efficiency_percent, false as has_sensitive from sc where err is null")
def q_result_json(spark, sf_dir):
    s, model = scored(spark, sf_dir)
    doc = single_result(passed(s), model)
    js = doc.select("source_index", RE.result_json(doc).alias("j"))
    return js.select(
        "source_index",
        F.array_join(F.array_sort(F.json_object_keys("j")), ",").alias("keys"),
        F.get_json_object("j", "$.data_quality.quality").alias("quality"),
        F.get_json_object("j", "$.predicted_efficiency_percent").cast("double").alias("predicted_efficiency_percent"),
        (F.col("j").contains("participant_uid") | F.col("j").contains("participant_email")).alias("has_sensitive"))


# ---------------------------------------------------------------- E2 / F3: boosted trees
def learnable_training(spark, sf_dir) -> DataFrame:
    """Valid nights with the fixture's learnable target (see FIXTURES.md)."""
    from nightjar.plans.batch import learnable_nights

    return feat.prepare_training(learnable_nights(nights(spark, sf_dir)).drop("email"))


@register("gbt_predictions", None)
def q_gbt_predictions(spark, sf_dir):
    return TR.cross_validate_gbt(learnable_training(spark, sf_dir), SPLITS).predictions.withColumn("date", iso("date"))


@register("attributions_gbt", None)
def q_attributions_gbt(spark, sf_dir):
    from nightjar.operators.gbt import fit_gbt
    from nightjar.operators.impute import fold_medians, imputation_values

    train = TR.checkpointed(learnable_training(spark, sf_dir), "train")
    med = imputation_values(fold_medians(train.withColumn("fold", F.lit(0)), n_splits=0), 0)
    scorer = fit_gbt(train, med)
    s = passed(SC.score_nights(nights(spark, sf_dir), scorer, valid_only=True))
    total = F.col("base_value")
    for f in K.MODEL_FEATURES:
        total = total + F.col(MO.shap_col(f))
    return s.select("source_index", "base_value", F.col("prediction").alias("predicted_efficiency"),
                    *[MO.shap_col(f) for f in K.MODEL_FEATURES],
                    F.abs(F.col("prediction") - total).alias("additivity_error"))


_FIT = ["tree", "node", "feature", "threshold", "value", "cover"]


@both("boosted_trees", _FIT, ["threshold", "value"], O.boosted_trees_sql())
def q_boosted_trees(spark, sf_dir):
    """The node table of a short fit over even bins, on features that both sides round alike."""
    from nightjar.operators.boosting import even_edges, fit_models
    from nightjar.operators.impute import fold_medians, imputation_values

    train = learnable_training(spark, sf_dir)
    train = TR.checkpointed(train.select("source_index", K.TARGET_NAME, *[F.round(f, 6).alias(f) for f in K.MODEL_FEATURES]), "train")
    med = imputation_values(fold_medians(train.withColumn("fold", F.lit(0)), n_splits=0), 0)
    return fit_models(train, {0: med}, (0,), O.SHORT_FIT, edges=even_edges).select(*_FIT)


def fixed_nodes():
    """The fixed ensemble as a node table."""
    import pandas as pd

    rows = [(-1, 0, -1, None, 0.0, 0)]
    for number, (tree, weight) in enumerate(zip(K.FIXED_TREES, K.FIXED_TREE_WEIGHTS)):
        def add(node, at, number=number, weight=weight) -> int:
            if len(node) == 2:
                rows.append((number, at, -1, None, weight * node[0], node[1]))
                return node[1]
            cover = add(node[2], 2 * at) + add(node[3], 2 * at + 1)
            rows.append((number, at, K.MODEL_FEATURES.index(node[0]), node[1], 0.0, cover))
            return cover

        add(tree, 1)
    return pd.DataFrame(rows, columns=_FIT).astype({"threshold": float})


_TA = ["source_index", "base_value", *[MO.shap_col(f) for f in K.MODEL_FEATURES], "predicted_efficiency"]


@both("tree_attribution_fixed", _TA, _TA[1:], O.tree_attribution_sql())
def q_tree_attribution_fixed(spark, sf_dir):
    from nightjar.operators.gbt import with_attributions, with_imputed

    rows = feat.engineer_features(nights(spark, sf_dir)).select("source_index", *K.MODEL_FEATURES)
    return with_attributions(with_imputed(rows, {}), fixed_nodes()).withColumnRenamed("prediction", "predicted_efficiency")


@register("date_spellings", f"select event_id as source_index, spelled, {O.iso(O.parse_date('spelled'))} as night_date "
                            f"from (select event_id, {O.SPELLED_DATE} as spelled from events) d")
def q_date_spellings(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").selectExpr("event_id as source_index", f"{O.SPELLED_DATE} as date")
    return coerce.parse_dates(rows).select("source_index", F.col("date").alias("spelled"), iso("night_date").alias("night_date"))


@both("read_nights_csv", ["file_row", "record_label", "errors", "predicted_efficiency"], ["predicted_efficiency"],
      O.with_(*O.batch_ctes(with_mae=False)) + f"select file_row, {O.label_sql('file_row')} as record_label, errors_text as errors, case when err is null then pred end as predicted_efficiency "
      "from (select * exclude (record_label), cast(row_number() over (order by source_index) - 1 as bigint) as file_row from sc) x")
def q_read_nights_csv(spark, sf_dir):
    """Nights written as CSV, read back by the engine's own reader, numbered and scored."""
    model = fit_fixture_model(nights(spark, sf_dir), with_metrics=False)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/nightjar/csv-{uuid.uuid4().hex}"
    nights(spark, sf_dir).orderBy("source_index").drop("source_index").write.option("header", True).csv(path)
    s = SC.score_nights(read_nights(spark, path, "csv", null_values=False), model)
    return s.select(F.col("source_index").cast("long").alias("file_row"), "record_label", joined("errors").alias("errors"),
                    F.when(F.col("error").isNull(), F.col("prediction")).alias("predicted_efficiency"))


from nightjar.plans import saved  # noqa: E402,F401  (registers its queries)


def queries() -> dict[str, QueryFn]:
    return {name: fn for name, (fn, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql is not None}
