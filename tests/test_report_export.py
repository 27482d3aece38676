import json
import os

import pytest
from conftest import text_frame
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.functions.formatting import fixed_decimals
from nightjar.operators.model import LinearScorer
from nightjar.operators.quality import validate_schema
from nightjar.operators.report import deterministic_report, result_json, safe_struct
from nightjar.operators.score import batch_results, batch_summary, score_nights
from nightjar.plans.batch import export_batch
from nightjar.sinks.export import EXPORT_PARTS, committed, save_evaluation_outputs, write_batch_csv, write_batch_export

FACTOR = "array<struct<feature:string,display_name:string,feature_value:double,shap_value:double>>"


#: No wording may name an illness or a cause.
K_FORBIDDEN = ("insomnia", "apnoea", "apnea", "caffeine", "alcohol", "stress", "disorder")


def report(spark, mae, low, warnings=()):
    df = spark.createDataFrame([(82.4, "mildly reduced efficiency", mae, low, [], list(warnings))],
                               f"p double, b string, m double, lo {FACTOR}, up {FACTOR}, w array<string>")
    return df.select(deterministic_report(F.col("p"), F.col("b"), F.col("m"), F.col("lo"), F.col("up"),
                                          F.col("w"))).collect()[0][0]


def test_every_part_of_the_template_is_filled(spark):
    text = report(spark, 4.75, [("rmssd", "heart-rate variability", 21.0, -0.125)], ["short night"])
    lines = [line for line in text.split("\n") if line]
    assert lines[:2] == [K.REPORT_TITLE, K.REPORT_ESTIMATE.format(predicted="82.4", band="mildly reduced efficiency")]
    assert K.REPORT_FACTOR_LINE.format(label="heart-rate variability", direction=K.REPORT_LOWER, value="0.12") in lines
    assert any(K.REPORT_MAE.format(mae="4.8") in line for line in lines) and text.endswith(K.REPORT_NOTES + "short night") is (K.REPORT_NOTES + "short night" in text[-30:])
    fixed = [getattr(K, name) for name in dir(K) if name.startswith("REPORT_")]
    assert not any(word in part.lower() for part in [text, *fixed] for word in K_FORBIDDEN)


def test_report_without_mae_or_factors(spark):
    text = report(spark, None, [], ["a", "b"])
    assert "Validated model error is not available" in text
    assert "- No individual model contributions were available." in text
    assert "non-diagnostic. Data-quality notes: a; b" in text


def test_number_printing_matches_python(spark):
    vals = [0.25, 0.35, 2.675, 84.65, 0.125, 1.005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(fixed_decimals(F.col("x"), 2)).collect()]
    assert got == ["%.2f" % v for v in vals]
    got1 = [r[0] for r in df.select(fixed_decimals(F.col("x"), 1)).collect()]
    assert got1 == ["%.1f" % v for v in vals]


def test_json_drops_sensitive_keys_recursively(spark):
    df = spark.createDataFrame(
        [(82.4, "secret", "uuid", {"participant_email": "e", "quality": "Good"}, [{"API_KEY": "k", "x": 1}])],
        "prediction double, OPENAI_API_KEY string, participant_uid string, "
        "dq struct<participant_email:string, quality:string>, items array<struct<API_KEY:string, x:int>>")
    text = df.select(result_json(df)).collect()[0][0]
    assert json.loads(text) == {"prediction": 82.4, "dq": {"quality": "Good"}, "items": [{"x": 1}]}
    assert "secret" not in text
    assert safe_struct(df) is not None


def test_exports_are_written(spark, tmp_path):
    results = spark.createDataFrame([(2, 82.4, None), (3, None, "invalid")],
                                    "source_row int, predicted_efficiency double, error string")
    write_batch_csv(results, str(tmp_path / "csv"))
    assert "predicted_efficiency" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    errors = results.filter("error is not null").select("source_row", "error")
    preview = spark.range(0, 250).withColumnRenamed("id", "source_index")
    parts = write_batch_export(results, errors, str(tmp_path / "x"), preview=preview)
    assert parts == list(EXPORT_PARTS)
    assert spark.read.parquet(str(tmp_path / "x" / "Analysis_Results")).count() == 1
    assert spark.read.parquet(str(tmp_path / "x" / "Input_Preview")).count() == 100
    preds = spark.createDataFrame([("p", "2020-01-01", 80.0, 81.0, 1.0, 1, 99)],
                                  "participant_id string, date string, actual_efficiency double, "
                                  "predicted_efficiency double, absolute_error double, fold int, extra int")
    save_evaluation_outputs(str(tmp_path / "eval"), spark.createDataFrame([(1.0,)], "mae double"),
                            spark.createDataFrame([(1, 1.0)], "fold int, mae double"), preds)
    header = next((tmp_path / "eval" / "test_predictions").glob("*.csv")).read_text().splitlines()[0]
    assert header == "participant_id,date,actual_efficiency,predicted_efficiency,absolute_error,fold"


def failing(spark):
    """Forty rows, of which the thirty-eighth can't be computed."""
    return spark.range(0, 40, 1, 4).select(
        F.col("id").alias("source_row"), F.lit("x").alias("record_label"),
        F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise(F.when(F.col("id") % 2 == 0, "e")).cast("string").alias("error"))


@pytest.mark.parametrize("there", [False, True])
def test_a_failing_task_leaves_no_part_behind(spark, tmp_path, there):
    good, preview = failing(spark).filter("source_row < 37"), spark.range(3).withColumnRenamed("id", "source_index")
    path = str(tmp_path / "out")
    if there:
        write_batch_export(good, None, path, preview=preview)
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    with pytest.raises(Exception, match="lost"):
        write_batch_export(failing(spark), None, path, preview=preview)
    with pytest.raises(Exception, match="lost"):  # the results are there already when the errors fail
        write_batch_export(good, failing(spark).select("source_row", "error"), path)
    with pytest.raises(Exception, match="lost"):
        write_batch_csv(failing(spark), path)
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before
    assert write_batch_export(good, None, path) == list(EXPORT_PARTS[:2])  # replaced whole: no preview of before
    assert sorted(os.listdir(path)) == sorted(EXPORT_PARTS[:2]) and os.listdir(tmp_path) == ["out"]
    counts = [spark.read.parquet(f"{path}/{part}").count() for part in EXPORT_PARTS[:2]]
    assert counts == [18, 19]


def test_files_that_are_there_are_replaced_or_refused(spark, tmp_path):
    rows, path = failing(spark).filter("source_row < 5"), str(tmp_path / "out")
    write_batch_csv(rows, path, mode="error")
    with pytest.raises(FileExistsError):
        write_batch_csv(rows, path, mode="error")
    with pytest.raises(ValueError, match="append"):
        write_batch_csv(rows, path, mode="append")
    write_batch_csv(spark.read.option("header", True).csv(path).limit(2), path)  # read while it is replaced
    assert spark.read.option("header", True).csv(path).count() == 2
    with pytest.raises(KeyboardInterrupt), committed(spark, path) as folder:
        rows.write.parquet(f"{folder}/a")
        raise KeyboardInterrupt
    assert os.listdir(tmp_path) == ["out"] and spark.read.option("header", True).csv(path).count() == 2


def test_one_pass_writes_and_observes(spark, tmp_path, valid_record):
    rows = [{**valid_record, "participant_id": f"S{i}", "total": 0 if i % 5 == 4 else 28800, "efficiency": 80 + i % 7} for i in range(60)]
    frame, seen = text_frame(spark, rows).repartition(5), spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    scorer = LinearScorer(medians={f: 0.0 for f in K.MODEL_FEATURES}, metrics={"mae_mean": 3.0})
    summary, report = export_batch(frame.mapInArrow(passing, frame.schema), scorer, str(tmp_path / "out"), with_preview=False)
    assert seen.value == 60
    results = batch_results(score_nights(frame, scorer), scorer.model_mae)
    want = batch_summary(results).first().asDict()
    got = summary.first().asDict()
    assert got.pop("mean_predicted_efficiency") == pytest.approx(want.pop("mean_predicted_efficiency")) and got == want
    assert report.collect() == validate_schema(frame).collect() and report.first()["n_error_rows"] == 12
    parts = [spark.read.parquet(str(tmp_path / "out" / part)).count() for part in EXPORT_PARTS[:2]]
    assert parts == [48, 12]


def test_export_of_tables_without_rows_or_columns(spark, tmp_path, valid_record):
    scorer = LinearScorer(medians={f: 0.0 for f in K.MODEL_FEATURES})
    none = text_frame(spark, [valid_record]).filter("false")
    summary, report = export_batch(none, scorer, str(tmp_path / "none"))
    assert tuple(summary.first()) == (0, 0, 0, None)
    assert report.collect() == validate_schema(none).collect() and report.first()["state"] == K.STATE_BLOCKED
    with pytest.raises(ValueError, match="total"):
        export_batch(text_frame(spark, [valid_record]).drop("total"), scorer, str(tmp_path / "less"))
    assert os.listdir(tmp_path) == ["none"]


def test_entries_open_a_document_in_one_pass(spark):
    from nightjar.plans.saved import entries

    texts = ['{"a": 1, "b": {"c": [], "d": ["x", null, {"e": 2.5}], "f": {}}, "g": null}', '[[["p", [[1]]]]]', '5', None]
    found = entries(spark.createDataFrame(list(enumerate(texts)), "source_index long, j string"))
    assert sorted(found.collect(), key=lambda r: (r[0], r[1])) == [
        (0, "a", 1.0, None), (0, "b.d[0]", None, "x"), (0, "b.d[1]", None, None), (0, "b.d[2].e", 2.5, None), (0, "g", None, None), (1, "0][0][0]", None, "p")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
