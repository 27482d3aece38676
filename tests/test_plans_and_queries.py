"""Plan checks and a small-scale oracle run (sf0.001) of the catalog."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from nightjar import constants as K

FAST = ["load_nights", "clean_numeric", "prepare_rows", "dq_errors", "dq_warnings", "schema_report", "features",
        "training_set", "record_labels", "participant_folds", "fold_medians", "spearman", "cv_summary",
        "batch_results", "top_factors", "reports", "error_histogram", "tree_attribution_fixed", "date_spellings", "read_nights_csv",
        "batch_results_trees", "saved_bundle", "bundle_refusals", "leakage_columns", "batch_csv", "result_document",
        "export_observed", "stream_report"]


def _canon(df):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        row = []
        for v in rec:
            if v is None or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif hasattr(v, "item"):
                row.append(v.item())
            else:
                row.append(v)
        out.append(tuple(row))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"create view events as select * from read_parquet('{SF_SMALL}/events.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    expect = duck.sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expect.columns)
    assert _canon(got) == _canon(expect)


def test_every_query_has_oracle_unless_rows_only():
    from nightjar.plans import catalog

    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"gbt_predictions", "attributions_gbt", "batch_results_gbt"}
    assert len(catalog.queries()) == 67 and set(catalog.queries()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == K.BATCH_RESULT_COLUMNS
    assert df.count() == 1000


def test_row_local_batch_path_has_no_shuffle_or_python(spark):
    from nightjar.operators.model import LinearScorer
    from nightjar.operators.score import batch_results, score_nights
    from nightjar.sources.nights import nights_from_events

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    nights = nights_from_events(events)
    scorer = LinearScorer(medians={f: 1.0 for f in K.MODEL_FEATURES})
    plan = batch_results(score_nights(nights, scorer), None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_prunes_columns(spark):
    from nightjar.sources.nights import read_table
    df = read_table(spark, SF_SMALL, "events").select("event_id", "user_id").filter("user_id = 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan and "PushedFilters" in plan


def test_streaming_smoke(spark, tmp_path):
    import shutil
    from nightjar.operators.model import LinearScorer
    from nightjar.streaming import start_scoring_stream

    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{SF_SMALL}/events.parquet", src / "part-0.parquet")
    schema = spark.read.parquet(str(src)).schema
    scorer = LinearScorer(medians={f: 0.0 for f in K.MODEL_FEATURES})
    q = start_scoring_stream(spark, str(src), schema, scorer, str(tmp_path / "out"), str(tmp_path / "ck"),
                             from_events=True)
    q.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 1000 and out.columns == K.BATCH_RESULT_COLUMNS


def test_filter_on_scored_rows_stays_above_the_projection(spark):
    from nightjar.operators.model import LinearScorer
    from nightjar.operators.score import passed, score_nights
    from nightjar.sources.nights import nights_from_events

    nights = nights_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    scorer = LinearScorer(medians={f: 1.0 for f in K.MODEL_FEATURES})
    plan = passed(score_nights(nights, scorer))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and all("Filter __keep" in line for line in filters)
