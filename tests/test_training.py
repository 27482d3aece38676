from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.features import PreprocessingError
from nightjar.operators.folds import GroupedValidationError, fold_overlap, refuse_overlap
from nightjar.operators.gbt import VECTOR, load_bundle
from nightjar.operators.metrics import METRIC_NAMES
from nightjar.operators.model import LinearScorer
from nightjar.plans.training import cross_validate_gbt, summary_dict, train_and_save


def sleepers(spark, nights=(9, 2, 2, 2, 2, 1)):
    """Nights of several people, the first with half of them; independent features, efficiency follows two of them."""
    rows, rng = [], np.random.default_rng(8)
    for person, n in enumerate(nights):
        for _ in range(n):
            x = dict(zip(K.MODEL_FEATURES, rng.random(len(K.MODEL_FEATURES)).tolist()))
            rows.append({"participant_id": f"S{person}", "date": date(2023, 1, 1) + timedelta(days=len(rows)), **x, "efficiency": 70 + 9 * x["deep_sleep_percent"] - 4 * x["restless"]})
    return spark.createDataFrame(pd.DataFrame(rows))


def test_every_person_is_predicted_by_models_that_never_saw_them(spark):
    data = sleepers(spark)
    result = cross_validate_gbt(data, n_splits=3, max_iter=3)
    per_person = result.predictions.groupBy("participant_id").agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("n")).collect()
    assert {r["participant_id"]: (r["folds"], r["n"]) for r in per_person} == {f"S{i}": (1, n) for i, n in enumerate((9, 2, 2, 2, 2, 1))}
    per_fold = result.fold_metrics().collect()
    assert sorted(r["number_of_rows"] for r in per_fold) == [4, 5, 9] and {r["participant_overlap_count"] for r in per_fold} == {0}
    summary = summary_dict(result.summary())
    assert summary["n_splits"] == 3 and summary["validation"] == K.VALIDATION_NAME
    assert {f"{m}{end}" for m in METRIC_NAMES for end in ("", "_mean", "_std")} <= set(summary)
    assert result.predictions.columns == K.OOF_COLUMNS


def test_another_estimator_and_no_rows(spark):
    data = sleepers(spark, (27, 6, 6, 6, 6, 3))  # 27 rows a fold for 16 coefficients
    result = cross_validate_gbt(data, n_splits=2, estimator=lambda: LinearRegression(featuresCol=VECTOR, labelCol="efficiency"))
    assert result.mae_metrics()["mae"] < 1e-6
    with pytest.raises(PreprocessingError, match="No valid training rows"):
        cross_validate_gbt(data.limit(0), n_splits=2)


def test_people_on_both_sides_are_refused(spark):
    mixed = spark.createDataFrame([("S1", 1), ("S1", 2), ("S2", 2)], "participant_id string, fold int")
    with pytest.raises(GroupedValidationError, match="both parts"):
        refuse_overlap(fold_overlap(mixed))
    assert refuse_overlap(fold_overlap(mixed.filter("participant_id = 'S2'"))).count() == 1


def test_train_and_save_writes_a_loadable_bundle(spark, tmp_path):
    scorer, _ = train_and_save(sleepers(spark), str(tmp_path / "model"), n_splits=3, max_iter=3)
    meta = spark.read.json(str(tmp_path / "model" / "bundle")).collect()[0]
    assert (meta["training_rows"], meta["training_participants"]) == (18, 6)
    assert meta["model_version"] == K.MODEL_VERSION and list(meta["feature_names"]) == K.MODEL_FEATURES
    loaded = load_bundle(str(tmp_path / "model"))
    assert loaded.model_mae == scorer.model_mae


def test_model_mae_falls_back_to_overall():
    assert LinearScorer(medians={}, metrics={"mae": 2.0}).model_mae == 2.0
    assert LinearScorer(medians={}, metrics={"mae": 2.0, "mae_mean": 1.5}).model_mae == 1.5
    assert LinearScorer(medians={}).model_mae is None


def test_batch_results_invariant_to_partitioning(spark):
    from conftest import SF_SMALL
    from nightjar.operators.score import batch_results, score_nights
    from nightjar.sources.nights import NIGHT_VIEW_COLUMNS

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    scorer = LinearScorer(medians={f: 0.5 for f in K.MODEL_FEATURES}, metrics={"mae_mean": 2.5})

    def run(n):
        nights = events.repartition(n).selectExpr(*NIGHT_VIEW_COLUMNS)
        rows = batch_results(score_nights(nights, scorer), scorer.model_mae).collect()
        return sorted(tuple(r) for r in rows)

    one, many = run(1), run(16)
    assert len(one) == 1000 and one == many
