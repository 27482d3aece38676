"""Regression metrics per fold and overall, chart tables.

Metrics are plain aggregates (one ``groupBy(fold)``); Pearson uses
population moments guarded by ``try_divide`` and a min<>max test (Spark's
``corr`` raises under ANSI on a constant side); R^2 is 1 - SSE/SST with the
n<2 and SST=0 rules; Spearman is Pearson on tie-averaged ranks computed
with the distributed ranker (no single-partition window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.ranks import BUCKET, average_ranks, range_buckets

ACTUAL, PREDICTED = "actual_efficiency", "predicted_efficiency"
METRIC_NAMES = ["mae", "rmse", "r2", "pearson_correlation", "spearman_correlation"]


def guarded_pearson(x: str, y: str) -> list[Column]:
    """Aggregates whose combination ``pearson_from`` gives r or NULL."""
    return [
        F.count(F.lit(1)).alias("_n"),
        F.covar_pop(x, y).alias("_cov"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
        (F.min(x) < F.max(x)).alias("_x_varies"), (F.min(y) < F.max(y)).alias("_y_varies"),
    ]


def pearson_from(prefix: str = "") -> Column:
    p = prefix
    r = F.try_divide(F.col(f"{p}_cov"), F.sqrt(F.col(f"{p}_vx") * F.col(f"{p}_vy")))
    ok = (F.col(f"{p}_n") >= 2) & F.col(f"{p}_x_varies") & F.col(f"{p}_y_varies")
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def regression_aggs(actual: str = ACTUAL, predicted: str = PREDICTED) -> list[Column]:
    err = F.col(actual) - F.col(predicted)
    return [
        F.count(F.lit(1)).alias("number_of_rows"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(actual) * F.count(F.lit(1))).alias("_sst"),
        F.avg(actual).alias("mean_actual_efficiency"),
        F.avg(predicted).alias("mean_predicted_efficiency"),
        *guarded_pearson(actual, predicted),
    ]


def r2_from() -> Column:
    sse, sst = F.col("_sse"), F.col("_sst")
    return (F.when(F.col("number_of_rows") < 2, F.lit(None).cast("double"))
            .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - sse / sst))


def _finish(agg: DataFrame) -> DataFrame:
    return agg.withColumn("r2", r2_from()).withColumn("pearson_correlation", pearson_from()) \
        .drop("_sse", "_sst", "_n", "_cov", "_vx", "_vy", "_x_varies", "_y_varies")


def centred_ranks(pairs: DataFrame, value: str, other: str, num_buckets: int | None = None) -> DataFrame:
    """Adds ``_n`` (rows of the group) and ``_rank``, the tie-averaged rank of ``value`` less the mean rank.

    ``pairs`` are distinct on (_g, value, other) with ``_cnt`` rows each. They are range-partitioned by
    all three, so a value held by many pairs is in as many buckets as it fills. The ranks inside a
    bucket are then moved by what the other buckets hold: a small table with the rows of
    each bucket and group, and of its first and last values, which alone may be in other buckets as well.
    """
    bucketed = range_buckets(pairs, [F.col("_g"), F.col(value), F.col(other)], num_buckets)
    own = ["_g", BUCKET]
    per_value = bucketed.groupBy(*own, F.col(value).alias("_v")).agg(F.sum("_cnt").alias("_rows"))
    ends = bucketed.groupBy(*own).agg(F.sum("_cnt").alias("_held"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    # At most buckets + groups rows, and two a row of the edges below: bounded broadcasts.
    earlier = Window.partitionBy("_g").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(*own, F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_off"),
                          F.sum("_held").over(Window.partitionBy("_g")).alias("_n"))
    edge = per_value.join(F.broadcast(ends), own).filter((F.col("_v") == F.col("_lo")) | (F.col("_v") == F.col("_hi")))
    same = Window.partitionBy("_g", "_v").orderBy(BUCKET)
    edges = edge.select(*own, F.col("_v").alias(value),
                        F.coalesce(F.sum("_rows").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_prev"),
                        F.coalesce(F.sum("_rows").over(same.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("_next"))
    inside = Window.partitionBy(*own).orderBy(value)
    counted = bucketed.select(
        "*", F.sum("_cnt").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
        F.sum("_cnt").over(inside.rangeBetween(Window.currentRow, Window.currentRow)).alias("_ties"))
    placed = counted.join(F.broadcast(offsets), own).join(F.broadcast(edges), [*own, value], "left")
    prev, after = F.coalesce("_prev", F.lit(0)), F.coalesce("_next", F.lit(0))
    first = F.col("_off") + F.col("_upto") - F.col("_ties") - prev
    rank = first + (F.col("_ties") + prev + after + F.lit(1.0)) / 2.0
    return placed.select(*pairs.columns, "_n", (rank - (F.col("_n") + F.lit(1.0)) / 2.0).alias("_rank"))


def spearman(preds: DataFrame, fold: str = "fold", actual: str = ACTUAL, predicted: str = PREDICTED,
             num_buckets: int | None = None) -> DataFrame:
    """``fold, spearman_correlation`` per fold and for all rows (fold 0).

    The distinct (group, actual, predicted) pairs, counted map-side, carry the ranks of their
    actual values. Summed per predicted value, these need only the rank of that value, so
    no row and no pair is joined with a rank table. Rows without either value have no rank.
    """
    base = preds.select(F.col(fold).alias("_g"), F.col(actual).alias("_a"), F.col(predicted).alias("_p")).dropna(subset=["_a", "_p"])
    pairs = base.unionByName(base.withColumn("_g", F.lit(0).cast(base.schema["_g"].dataType))) \
        .groupBy("_g", "_a", "_p").agg(F.count(F.lit(1)).alias("_cnt"))
    rank = F.col("_rank")
    values = centred_ranks(pairs, "_a", "_p", num_buckets).groupBy("_g", "_p").agg(
        F.sum("_cnt").alias("_cnt"), F.max("_n").alias("_n"),
        F.sum(F.col("_cnt") * rank).alias("_sa"), F.sum(F.col("_cnt") * rank * rank).alias("_saa"))
    centre = F.col("avg_rank") - (F.col("_n") + F.lit(1.0)) / 2.0
    agg = average_ranks(values, "_p", "_cnt", ["_g"], num_buckets).groupBy("_g").agg(
        F.sum(F.col("_sa") * centre).alias("_cov"), F.sum("_saa").alias("_va"), F.sum(F.col("_cnt") * centre * centre).alias("_vp"))
    r = F.col("_cov") / (F.sqrt("_va") * F.sqrt("_vp"))
    # All ranks of a constant side are the mean rank: its sum of squares is 0, without rounding.
    varies = (F.col("_va") > 0) & (F.col("_vp") > 0)
    return agg.select(F.col("_g").alias(fold), F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("spearman_correlation"))


def fold_metrics(preds: DataFrame, fold: str = "fold", participant: str = K.PARTICIPANT_COLUMN,
                 spearman_table: DataFrame | None = None, overlap: DataFrame | None = None) -> DataFrame:
    """One row per fold."""
    agg = preds.groupBy(fold).agg(*regression_aggs(),
                                  F.countDistinct(participant).alias("number_of_participants"))
    out = _finish(agg)
    sp = spearman_table if spearman_table is not None else spearman(preds, fold)
    out = out.join(F.broadcast(sp), fold, "left")
    if overlap is not None:
        out = out.join(F.broadcast(overlap.select(fold, "participant_overlap_count")), fold, "left")
    else:
        out = out.withColumn("participant_overlap_count", F.lit(0).cast("long"))
    return out.select(fold, *METRIC_NAMES, "number_of_rows", "number_of_participants",
                      "mean_actual_efficiency", "mean_predicted_efficiency", "participant_overlap_count")


def cv_summary(preds: DataFrame, folds_table: DataFrame, n_splits: int, fold: str = "fold",
               participant: str = K.PARTICIPANT_COLUMN, spearman_table: DataFrame | None = None) -> DataFrame:
    """Overall metrics + mean / population std over folds of five metrics."""
    sp = spearman_table if spearman_table is not None else spearman(preds, fold)
    overall = _finish(preds.agg(*regression_aggs(), F.countDistinct(participant).alias("number_of_participants")))
    overall = overall.crossJoin(F.broadcast(sp.filter(F.col(fold) == 0).select("spearman_correlation")))
    across = folds_table.agg(*[
        agg(F.col(m)).alias(f"{m}_{suffix}") for m in METRIC_NAMES
        for agg, suffix in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    # Both sides are one-row aggregates.
    return overall.crossJoin(F.broadcast(across)).select(
        *METRIC_NAMES, "number_of_rows", "number_of_participants", "mean_actual_efficiency",
        "mean_predicted_efficiency", *[f"{m}_{s}" for m in METRIC_NAMES for s in ("mean", "std")],
        F.lit(K.VALIDATION_NAME).alias("validation"), F.lit(n_splits).alias("n_splits"))


def residuals(preds: DataFrame, keys: Sequence[str] = ("source_index",)) -> DataFrame:
    """Residual per row plus the common axis limits (one-row aggregate)."""
    lim = preds.agg(F.least(F.min(ACTUAL), F.min(PREDICTED)).alias("axis_min"),
                    F.greatest(F.max(ACTUAL), F.max(PREDICTED)).alias("axis_max"))
    return preds.select(*keys, ACTUAL, PREDICTED, (F.col(ACTUAL) - F.col(PREDICTED)).alias("residual")) \
        .crossJoin(F.broadcast(lim))


def error_histogram(preds: DataFrame, value: str = "absolute_error", bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), empty bins included.

    Bin edges follow ``linspace``; a value is moved one bin down/up when it
    falls below its left edge / on or above its right edge, as histogram
    routines do to absorb rounding in the bin arithmetic.
    """
    rng = preds.agg(F.min(value).alias("_lo0"), F.max(value).alias("_hi0")).select(
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    step = (hi - lo) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(i.cast("double") * step + lo)

    x = F.col(value)
    idx0 = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo)))
    idx1 = F.when(idx0 == bins, F.lit(bins - 1)).otherwise(idx0)
    idx2 = F.when(x < edge(idx1), idx1 - 1).otherwise(idx1)
    idx3 = F.when((x >= edge(idx2 + 1)) & (idx2 != bins - 1), idx2 + 1).otherwise(idx2)
    counts = preds.filter(x.isNotNull()).crossJoin(F.broadcast(rng)) \
        .select(idx3.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi")
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))
