import pytest
from conftest import text_frame

from nightjar import constants as K
from nightjar.operators.model import LinearScorer
from nightjar.operators.quality import validate_schema
from nightjar.operators.score import batch_results, batch_summary, score_nights
from nightjar.streaming import read_reports, start_report_stream

SCORER = LinearScorer(medians={f: 0.0 for f in K.MODEL_FEATURES})
MEAN = "mean_predicted_efficiency"


def arrive(spark, folder, rows, name):
    frame = text_frame(spark, rows, extra_columns=["participant_id", "efficiency"])
    frame.coalesce(1).write.parquet(f"{folder}/{name}")
    return frame.schema


def run(spark, tmp_path, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    start_report_stream(stream, SCORER, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(200)
    return {r["batch"]: r.asDict() for r in read_reports(spark, str(tmp_path / "out")).collect()}


def test_a_report_after_every_batch_and_a_restart(spark, tmp_path, valid_record):
    """Only faulty rows at first (blocked), then good ones; the second run goes on with the counts of the first."""
    bad, good = {**valid_record, "total": 0}, {**valid_record, "efficiency": 84}
    parts = {"a": [bad, bad], "b": [good, bad], "c": [good] * 3, "d": [{**good, "rem": 5000}, bad]}
    schema = None
    for name in "ab":
        schema = arrive(spark, tmp_path / "in", parts[name], name)
    assert set(run(spark, tmp_path, schema)) == {0, 1}
    for name in "cd":
        arrive(spark, tmp_path / "in", parts[name], name)
    reports = run(spark, tmp_path, schema)
    assert set(reports) == {0, 1, 2, 3}
    assert reports[0]["state"] == K.STATE_BLOCKED and reports[3]["state"] == K.STATE_WARN
    for batch in range(4):
        rows = spark.read.schema(schema).parquet(*[f"{tmp_path}/in/{name}" for name in "abcd"[:batch + 1]])
        expected = validate_schema(rows).first().asDict() | batch_summary(batch_results(score_nights(rows, SCORER))).first().asDict()
        got = reports[batch]
        assert got.pop("batch") == batch
        assert got.pop(MEAN) == pytest.approx(expected.pop(MEAN)) and got == expected


def test_a_stream_without_required_columns_is_refused(spark, tmp_path, valid_record):
    schema = arrive(spark, tmp_path / "in", [{k: v for k, v in valid_record.items() if k != "total"}], "a")
    with pytest.raises(ValueError, match="total"):
        run(spark, tmp_path, schema)
