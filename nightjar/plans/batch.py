"""Entry 1 (flagship): dirty nights -> 14-column batch results.

source -> validate -> features -> score -> attribute -> assemble, one
narrow lineage with no shuffle; the model's scalars (medians, MAE) are
literals collected once at fit time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.features import prepare_training
from nightjar.operators.model import LinearScorer, fit_linear_scorer
from nightjar.operators.quality import schema_columns, schema_counts, schema_report
from nightjar.operators.score import batch_results, score_nights, summary_aggregates
from nightjar.operators.impute import imputation_values
from nightjar.plans.training import cross_validate_linear
from nightjar.session import tune_session
from nightjar.sinks import write_batch_export


def fit_fixture_model(nights: DataFrame, n_splits: int = 5, with_metrics: bool = True) -> LinearScorer:
    """The linear fixture model fitted on the training view of the same nights.

    Email is masked into labels and dropped before training (participant_id kept).
    """
    tune_session(nights.sparkSession)
    train = prepare_training(nights.drop("email") if "participant_id" in nights.columns else nights)
    if not with_metrics:
        return fit_linear_scorer(train)
    # Fold 0 of the CV medians is the median over all training rows: the fit.
    result = cross_validate_linear(train, n_splits)
    return LinearScorer(medians=imputation_values(result.medians, 0), metrics=result.mae_metrics())


def run_batch(nights: DataFrame, scorer, generate_reports: bool = False,
              fallback_only: bool = False) -> DataFrame:
    tune_session(nights.sparkSession)
    scored = score_nights(nights, scorer)
    return batch_results(scored, scorer.model_mae, generate_reports, fallback_only)


def export_batch(nights: DataFrame, scorer, path: str, fmt: str = "parquet", with_preview: bool = True) -> tuple[DataFrame, DataFrame]:
    """The three-part export, with the one-row batch summary (F11) and schema report (C12-C14) of its rows.

    Both are observed while the rows are computed for the export, so the nights are validated
    and scored once. A table without a required column is refused before that.
    """
    missing = schema_columns(nights.columns)["missing"]
    if missing:
        raise ValueError(K.SCHEMA_MISSING + ", ".join(missing))
    spark = tune_session(nights.sparkSession)
    validated, summed = Observation(), Observation()
    scored = score_nights(nights, scorer).observe(validated, *schema_counts())
    results = batch_results(scored, scorer.model_mae).observe(summed, *summary_aggregates())
    write_batch_export(results, None, path, preview=nights if with_preview else None, fmt=fmt)
    counts = spark.createDataFrame([validated.get], "n_rows bigint, n_valid_rows bigint, n_error_rows bigint")
    summary = spark.createDataFrame([summed.get], "n_rows bigint, n_success bigint, n_failed bigint, mean_predicted_efficiency double")
    return summary, schema_report(counts, nights.columns)


def learnable_nights(nights: DataFrame) -> DataFrame:
    """Valid nights whose target is the fixture's learnable clean variant.

    efficiency = 85 + 0.05 (rmssd - 60) - 0.03 (restless - 60), on rows that
    pass validation (the raw efficiency column is noise by construction).
    """
    from nightjar.functions.numbers import lenient_number
    from nightjar.operators.lineage import filter_derived
    from nightjar.operators.quality import annotate_quality

    valid = filter_derived(annotate_quality(nights), F.size("errors") == 0)
    types = {f.name: f.dataType for f in nights.schema.fields}
    rmssd = lenient_number(F.col("rmssd"), types["rmssd"])
    restless = lenient_number(F.col("restless"), types["restless"])
    target = F.lit(85.0) + F.lit(0.05) * (rmssd - F.lit(60.0)) - F.lit(0.03) * (restless - F.lit(60.0))
    return valid.select(*[c for c in nights.columns if c != "efficiency"], target.alias("efficiency"))
