"""Entry 2: participant-grouped cross-validation and the final fit.

The table of prepared training rows gets a fold per participant; the
linear fixture model is "fitted" by fold medians (one distributed pass for
all folds), the boosted trees of all folds in shared passes. Predictions of
all folds are one DataFrame; every metric is an aggregate over it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.features import require_rows
from nightjar.operators.folds import attach_folds, check_participants, fold_overlap, participant_folds, refuse_overlap
from nightjar.operators.impute import fold_medians, impute_by_fold
from nightjar.operators.metrics import cv_summary, fold_metrics, spearman
from nightjar.operators.model import linear_oof_predictions
from nightjar.operators.ranks import checkpointed


@dataclass
class CVResult:
    with_folds: DataFrame
    folds: DataFrame
    medians: DataFrame
    predictions: DataFrame
    n_splits: int
    #: The node tables of all models (boosted trees), by the order of the fit.
    nodes: DataFrame | None = None

    def spearman(self) -> DataFrame:
        return spearman(self.predictions)

    def overlap(self) -> DataFrame:
        return fold_overlap(self.with_folds)

    def fold_metrics(self) -> DataFrame:
        return fold_metrics(self.predictions, spearman_table=self.spearman(), overlap=self.overlap())

    def mae_metrics(self) -> dict:
        """Overall and mean fold MAE (one small aggregate, collected)."""
        err = F.abs(F.col("actual_efficiency") - F.col("predicted_efficiency"))
        per_fold = self.predictions.groupBy("fold").agg(F.avg(err).alias("m"), F.sum(err).alias("s"),
                                                        F.count(F.lit(1)).alias("n"))
        row = per_fold.agg(F.avg("m").alias("mae_mean"), (F.sum("s") / F.sum("n")).alias("mae")).first()
        return {"mae": row["mae"], "mae_mean": row["mae_mean"]}

    def summary(self) -> DataFrame:
        sp = checkpointed(self.spearman(), "spearman")  # k + 1 rows, read twice
        folds = fold_metrics(self.predictions, spearman_table=sp, overlap=self.overlap())
        return cv_summary(self.predictions, folds, self.n_splits, spearman_table=sp)


def prediction_columns(scored: DataFrame, predicted: str = "predicted_efficiency") -> DataFrame:
    keys = [c for c in ("source_index",) if c in scored.columns]
    return scored.select(
        *keys, K.PARTICIPANT_COLUMN, "date", F.col(K.TARGET_NAME).alias("actual_efficiency"),
        F.col(predicted).alias("predicted_efficiency"),
        F.abs(F.col(K.TARGET_NAME) - F.col(predicted)).alias("absolute_error"), "fold")


def assign(train: DataFrame, n_splits: int = K.DEFAULT_SPLITS, num_buckets: int | None = None):
    folds = checkpointed(participant_folds(train, n_splits, num_buckets=num_buckets), "folds")
    check_participants(folds, n_splits)
    with_folds = attach_folds(train, folds)
    refuse_overlap(fold_overlap(with_folds))
    return folds, with_folds


def cross_validate_linear(train: DataFrame, n_splits: int = K.DEFAULT_SPLITS,
                          num_buckets: int | None = None) -> CVResult:
    # Each intermediate below is read by several later steps: write it once.
    train = require_rows(checkpointed(train, "train"))
    folds, wf = assign(train, n_splits, num_buckets)
    med = checkpointed(fold_medians(wf, n_splits, num_buckets=num_buckets), "medians")
    preds = checkpointed(prediction_columns(linear_oof_predictions(wf, med)), "oof")
    return CVResult(wf, folds, med, preds, n_splits)


def summary_dict(summary: DataFrame) -> dict:
    """Collect the one-row summary (bounded: one row)."""
    row = summary.first()
    return row.asDict() if row is not None else {}


def fold_imputation(medians: DataFrame) -> dict[int, dict[str, float | None]]:
    """(k+1) x 15 medians collected for the per-fold fits (bounded by the fit parameters)."""
    out: dict[int, dict[str, float | None]] = {}
    for r in medians.select("fold", "feature", "median").collect():
        out.setdefault(int(r["fold"]), {})[r["feature"]] = r["median"]
    return out


def cross_validate_gbt(train: DataFrame, n_splits: int = K.DEFAULT_SPLITS,
                       max_iter: int = K.GBT_PARAMS["n_estimators"], num_buckets: int | None = None,
                       estimator: Callable[[], Estimator] | None = None, final: bool = False) -> CVResult:
    """Out-of-fold predictions of boosted trees; the models of all folds are fitted in the same passes.

    With ``final`` so is model 0, on all rows. ``estimator`` makes another regressor
    for each fold (``gbt.VECTOR`` and the target as its columns).
    """
    from functools import reduce

    from nightjar.operators.boosting import Settings, fit_models
    from nightjar.operators.gbt import node_table, with_predictions

    train = require_rows(checkpointed(train, "train"))
    folds, wf = assign(train, n_splits, num_buckets)
    wf = checkpointed(wf, "train_folds")
    med = checkpointed(fold_medians(wf, n_splits, num_buckets=num_buckets), "medians")
    ks = range(1, n_splits + 1)
    if estimator is not None:
        scored = reduce(DataFrame.unionByName, [fit_estimator(wf, k, fold_imputation(med).get(k, {}), estimator) for k in ks])
        nodes = None
    else:
        nodes = fit_models(wf, fold_imputation(med), [*([0] if final else []), *ks], Settings(trees=max_iter))
        tables = {k: node_table(nodes, place) for place, k in enumerate([*([0] if final else []), *ks])}
        scored = with_predictions(impute_by_fold(wf, med), tables, "fold", list(K.MODEL_FEATURES))
    preds = checkpointed(prediction_columns(scored, "prediction"), "oof")
    return CVResult(wf, folds, med, preds, n_splits, nodes)


def fit_estimator(with_folds: DataFrame, k: int, medians: dict[str, float | None], estimator: Callable[[], Estimator]) -> DataFrame:
    """Fold k scored by an MLlib regressor fitted on the other folds."""
    from nightjar.operators.gbt import VECTOR, EstimatorScorer, assembled

    data = assembled(with_folds.filter(F.col("fold") != k), medians).select(VECTOR, K.TARGET_NAME)
    return EstimatorScorer(estimator().fit(data), medians).predict(with_folds.filter(F.col("fold") == k))


def train_and_save(train: DataFrame, path: str, n_splits: int = K.DEFAULT_SPLITS,
                   max_iter: int = K.GBT_PARAMS["n_estimators"]):
    """Grouped CV and the final fit on all rows, in the same passes, then the bundle."""
    from nightjar.operators.gbt import GBTScorer, node_table, save_bundle

    result = cross_validate_gbt(train, n_splits, max_iter, final=True)
    scorer = GBTScorer(node_table(result.nodes), fold_imputation(result.medians).get(0, {}), summary_dict(result.summary()))
    counts = result.folds.agg(F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("participants")).first()
    save_bundle(scorer, path, counts["rows"], counts["participants"])
    return scorer, result
