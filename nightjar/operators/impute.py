"""Exact median imputation fitted per training fold.

Medians are computed for every held-out fold k (over rows with fold <> k)
and for the whole table (k = 0, the final fit) by selection:

1. one pass makes a mergeable quantile sketch per (feature, fold); the sketches of
   all folds but k give a bracket that holds the middle of held-out fold k;
2. a second pass counts, per feature and fold, the rows below the bracket and every
   value inside it (map-side partial aggregation, so a value shared by a third of
   all rows is one counter, not a group); the weight of a value for held-out fold k is n_all - n_k;
3. the keys that cover the middle positions are picked. Up to ``WINDOW_ROWS`` rows inside a bracket a
   window per (feature, fold) ranks them, beyond that the distributed ranker (see ``ranks``).

The sketch only narrows the search: a bracket without its middle positions is
widened and counted again, at last to all values, so the result is exact. What is
collected is (k+1) x 15 brackets and medians. ``approx=True`` switches to
``percentile_approx`` for callers that accept it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightjar.constants import MODEL_FEATURES
from nightjar.operators.ranks import BUCKET, range_buckets, rows_before

#: Size of a sketch; its ranks are off by about a quarter of a percent.
SKETCH_K = 2048
#: How far a bracket reaches to either side of the middle, as a share of rows, and how much further after a miss.
MARGIN, WIDER = 0.01, 8
WINDOW_ROWS = 1 << 20
#: Steps in which a sketch is read.
SHARES = 200


def melt(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    return df.selectExpr(*keep, f"stack({len(features)}, {pairs}) as (feature, value)")


def fold_medians(train: DataFrame, n_splits: int, features: Sequence[str] = MODEL_FEATURES,
                 fold_col: str = "fold", num_buckets: int | None = None,
                 approx: bool = False, margin: float = MARGIN) -> DataFrame:
    """``fold, feature, median, n_values``: fold 0 = all rows, fold k = rows with fold <> k.

    ``num_buckets`` asks for the distributed ranker at any size. A feature without values has a NULL median.
    """
    ks = list(range(0, n_splits + 1))
    if approx:
        long = melt(train, features, [fold_col]).filter(F.col("value").isNotNull())
        return _complete(train, _approx_medians(long, ks, fold_col), features, ks)
    sketches = _sketches(train, features, fold_col, ks)
    medians: dict[tuple[str, int], float] = {}
    n_values = {(f, k): r[f"n_{f}"] for k, r in sketches.items() for f in features}
    wanted = list(features)
    while wanted:
        brackets = {f: _bracket(f, sketches, margin) for f in wanted}
        inside = max(2 * margin * n_values.get((f, 0), 0) for f in wanted)
        found = _middles(train, brackets, n_values, fold_col, ks, num_buckets, num_buckets is not None or inside > WINDOW_ROWS)
        medians |= found
        # A bracket that is all values holds every middle, so this ends.
        wanted = [f for f in wanted if brackets[f] is not None and any(n_values.get((f, k)) and (f, k) not in found for k in ks)]
        margin *= WIDER
    rows = [(k, f, medians.get((f, k)), n_values.get((f, k)) or 0) for k in ks for f in features]
    return train.sparkSession.createDataFrame(rows, "fold int, feature string, median double, n_values bigint")


def _sketches(train: DataFrame, features: Sequence[str], fold_col: str, ks: list[int]) -> dict[int, dict]:
    """Per held-out fold a row with each feature's number of values ``n_<f>`` and its sketch ``<f>``: one pass."""
    value = {f: F.col(f"`{f}`").cast("double") for f in features}
    per_fold = train.groupBy(F.col(fold_col).alias("__fold")).agg(
        *[F.count(value[f]).alias(f"n_{f}") for f in features], *[F.kll_sketch_agg_double(value[f], SKETCH_K).alias(f) for f in features])
    counted_for = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: (k == 0) | ~k.eqNullSafe(F.col("__fold").cast("int")))
    merged = per_fold.withColumn("__k", F.explode(counted_for)).groupBy("__k").agg(
        *[F.sum(f"n_{f}").alias(f"n_{f}") for f in features], *[F.kll_merge_agg_double(f, SKETCH_K).alias(f) for f in features])
    shares = F.lit([i / SHARES for i in range(SHARES + 1)])
    quantiles = [F.when(F.col(f"n_{f}") > 0, F.kll_sketch_get_quantile_double(f, shares)).alias(f) for f in features]
    rows = merged.select("__k", *[f"n_{f}" for f in features], *quantiles).collect()
    return {r["__k"]: r.asDict() for r in rows}


def _bracket(feature: str, sketches: dict[int, dict], margin: float) -> tuple[float, float] | None:
    """The values between which the middles of all held-out folds should lie; None: all values."""
    first, last = int((0.5 - margin) * SHARES), -int(-(0.5 + margin) * SHARES // 1)
    known = [r[feature] for r in sketches.values() if r[f"n_{feature}"]]
    if first < 0 or last > SHARES or not known or any(q is None for quantiles in known for q in quantiles):
        return None
    return min(q[first] for q in known), max(q[last] for q in known)


def _middles(train: DataFrame, brackets: dict[str, tuple[float, float] | None], n_values: dict[tuple[str, int], int], fold_col: str, ks: list[int],
             num_buckets: int | None, distributed: bool) -> dict[tuple[str, int], float]:
    """Medians by (feature, held-out fold) whose middle positions lie inside the feature's bracket."""
    parts = []
    for f, bracket in brackets.items():
        v = F.col(f"`{f}`").cast("double")
        # Values below the bracket are counted together, as NULL; those above it are not read on.
        key = v if bracket is None else F.when(v >= F.lit(bracket[0]), v)
        used = v.isNotNull() if bracket is None else v <= F.lit(bracket[1])
        parts.append(F.struct(F.lit(f).alias("feature"), key.alias("value"), used.alias("used")))
    long = train.select(F.col(fold_col), F.inline(F.array(*parts))).filter("used")
    held_out = {k: F.count_if(F.col(fold_col) == k) for k in ks[1:]}
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c_0"), *[(F.count(F.lit(1)) - n).alias(f"c_{k}") for k, n in held_out.items()])
    weights = [f"c_{k}" for k in ks]
    if distributed:
        order = [F.col("feature"), F.col("value").asc_nulls_first()]
        ranked = rows_before(range_buckets(counts, order, num_buckets), order, weights, groups=["feature"]).drop(BUCKET)
    else:
        earlier = Window.partitionBy("feature").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.select("*", *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"_before_{w}") for w in weights])
    stacked = ranked.select("feature", "value", F.inline(F.array(*[
        F.struct(F.lit(k).alias("fold"), F.col(f"c_{k}").alias("c"), F.col(f"_before_c_{k}").alias("before")) for k in ks])))
    totals = train.sparkSession.createDataFrame([(f, k, n) for (f, k), n in n_values.items() if f in brackets and n], "feature string, fold int, n bigint")
    # totals has at most 15 x (k+1) rows.
    covers = lambda p: (F.col("before") < p) & (p <= F.col("before") + F.col("c"))
    low, high = covers(F.floor((F.col("n") + 1) / 2)), covers(F.floor(F.col("n") / 2) + 1)
    picked = stacked.join(F.broadcast(totals), ["feature", "fold"]).filter(F.col("value").isNotNull() & (low | high)).groupBy("feature", "fold").agg(
        F.max(F.when(low, F.col("value"))).alias("low"), F.max(F.when(high, F.col("value"))).alias("high"))
    return {(r["feature"], r["fold"]): (r["low"] + r["high"]) / 2 for r in picked.collect() if r["low"] is not None and r["high"] is not None}


def _approx_medians(long: DataFrame, ks: list[int], fold_col: str) -> DataFrame:
    aggs = [F.percentile_approx("value", 0.5, 10000).alias("m_0"), F.count(F.lit(1)).alias("n_0")]
    for k in ks[1:]:
        v = F.when(F.col(fold_col) != k, F.col("value"))
        aggs += [F.percentile_approx(v, 0.5, 10000).alias(f"m_{k}"), F.count(v).alias(f"n_{k}")]
    wide = long.groupBy("feature").agg(*aggs)
    return wide.selectExpr(
        "feature", f"stack({len(ks)}, " + ", ".join(f"{k}, m_{k}, n_{k}" for k in ks)
        + ") as (fold, median, n_values)").select("fold", "feature", F.col("median").cast("double"), "n_values")


def _complete(train: DataFrame, med: DataFrame, features: Sequence[str], ks: list[int]) -> DataFrame:
    """One row per (fold, feature) even when a feature has no values (median NULL)."""
    spark = train.sparkSession
    grid = spark.createDataFrame([(k, f) for k in ks for f in features], "fold int, feature string")
    return grid.join(F.broadcast(med.withColumn("fold", F.col("fold").cast("int"))), ["fold", "feature"], "left") \
        .select("fold", "feature", "median", F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"))


def medians_wide(medians: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """One row per fold with a ``med_<feature>`` column each (<= k+1 rows)."""
    return medians.groupBy("fold").agg(*[
        F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"med_{f}") for f in features])


def impute_by_fold(df: DataFrame, medians: DataFrame, features: Sequence[str] = MODEL_FEATURES,
                   fold_col: str = "fold") -> DataFrame:
    """Replace NULL features by the medians fitted without the row's own fold.

    A feature with no training values is imputed as 0.0 (its column is kept
    so that attributions stay aligned with feature names).
    """
    wide = F.broadcast(medians_wide(medians, features).withColumnRenamed("fold", fold_col))
    joined = df.join(wide, on=fold_col, how="left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in features],
        *[F.coalesce(F.col(f), F.col(f"med_{f}"), F.lit(0.0)).alias(f) for f in features])


def imputation_values(medians: DataFrame, fold: int = 0) -> dict[str, float | None]:
    """Collect one fold's medians (15 numbers) for a fitted model."""
    rows = medians.filter(F.col("fold") == fold).select("feature", "median").collect()
    return {r["feature"]: r["median"] for r in rows}

