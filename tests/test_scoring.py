import pytest
from conftest import text_frame
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.explain import contribution_chart, lowering, increasing, top_factors
from nightjar.operators.model import LinearScorer
from nightjar.operators.score import batch_results, batch_summary, efficiency_band, score_nights, select_first_n

MEDIANS = {f: 0.0 for f in K.MODEL_FEATURES}


def run(spark, rows, **kw):
    scorer = LinearScorer(medians=MEDIANS, metrics={"mae_mean": 3.1})
    df = text_frame(spark, rows, extra_columns=["participant_id", "email", "efficiency"])
    return batch_results(score_nights(df, scorer), scorer.model_mae, **kw).orderBy("source_row").collect()


def test_batch_continues_after_invalid_row(spark, valid_record):
    out = run(spark, [valid_record, {**valid_record, "total": 0}])
    assert len(out) == 2 and list(out[0].asDict()) == K.BATCH_RESULT_COLUMNS
    assert out[0]["predicted_efficiency"] is not None and out[0]["error"] is None
    assert out[0]["report_status"] == "not requested" and out[0]["model_mae"] == 3.1
    assert out[1]["error"] == "total must be greater than zero; rem + deep cannot be greater than total"
    assert out[1]["data_quality"] == "Poor" and out[1]["predicted_efficiency"] is None
    assert out[1]["report_status"] == "failed"


def test_report_status_variants(spark, valid_record):
    assert run(spark, [valid_record], generate_reports=True)[0]["report_status"] == "generated"
    assert run(spark, [valid_record], generate_reports=True, fallback_only=True)[0]["report_status"] == \
        "deterministic fallback"


def test_non_numeric_actual_fails_the_row(spark, valid_record):
    out = run(spark, [{**valid_record, "efficiency": "abc", "participant_id": "P1"}])
    assert out[0]["error"] == "could not convert string to float: 'abc'"
    assert out[0]["participant_id"] == "P1" and out[0]["date"] == "2023-11-05"


def test_linear_prediction_and_main_factors(spark, valid_record):
    out = run(spark, [{**valid_record, "efficiency": 84}])[0]
    night = {**valid_record, "rem_sleep_percent": 22.5, "deep_sleep_percent": 15.0}
    parts = {f: c * (night[f] - centre) for f, (c, centre) in K.LINEAR_COEFFICIENTS.items()}
    expect = K.LINEAR_BASE + sum(parts.values())
    assert out["predicted_efficiency"] == pytest.approx(expect)
    assert out["absolute_error"] == pytest.approx(abs(expect - 84))
    assert out["main_lowering_factor"] == K.FEATURE_LABELS[min(parts, key=parts.get)]
    assert out["main_increasing_factor"] == K.FEATURE_LABELS[max(parts, key=parts.get)]


def test_band_thresholds(spark):
    df = spark.createDataFrame([(v,) for v in (90.0, 89.9, 85.0, 82.4, 79.99)], "p double")
    got = [r[0] for r in df.select(efficiency_band(F.col("p"))).collect()]
    assert got == ["high estimated efficiency", "generally efficient", "generally efficient",
                   "mildly reduced efficiency", "reduced efficiency"]


def test_top_factors_ties_and_zero_slots(spark):
    vals = [0.0, 2.0, -2.0, 0.0, 1.0, -3.0, 0.0]
    schema = "arr array<struct<feature:string,display_name:string,feature_value:double,shap_value:double>>"
    arr = [(f"f{i}", f"F{i}", None, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame([(arr,)], schema)
    top = df.select(top_factors(F.col("arr")).alias("t")).select(
        F.col("t"), lowering(F.col("t")).alias("lo"), increasing(F.col("t")).alias("up")).collect()[0]
    assert [x["feature"] for x in top["t"]] == ["f5", "f1", "f2", "f4", "f0"]
    assert [x["feature"] for x in top["lo"]] == ["f5", "f2"] and [x["feature"] for x in top["up"]] == ["f1", "f4"]
    chart = df.select(contribution_chart(lowering(top_factors(F.col("arr"))),
                                         increasing(top_factors(F.col("arr")))).alias("c")).collect()[0]["c"]
    assert [(c["display_name"], c["sign"]) for c in chart] == [("F5", "negative"), ("F2", "negative"),
                                                               ("F1", "positive"), ("F4", "positive")]


def test_summary_and_selection(spark, valid_record):
    scorer = LinearScorer(medians=MEDIANS)
    rows = [valid_record, {**valid_record, "total": 0}, valid_record]
    df = text_frame(spark, rows, extra_columns=["participant_id", "email", "efficiency"])
    res = batch_results(score_nights(df, scorer), None)
    s = batch_summary(res).collect()[0]
    assert (s["n_rows"], s["n_success"], s["n_failed"]) == (3, 2, 1)
    assert [r["source_index"] for r in select_first_n(df, 2).collect()] == [0, 1]
