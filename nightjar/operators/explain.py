"""Attribution factors, per-row top-k and chart data.

All row-local: the 15 factors of a row are an array of structs, sorted
inside the row with ``sort_array`` (key: -|contribution|, then canonical
position, so ties keep feature order). No window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.model import shap_col

FACTOR_FIELDS = ["feature", "display_name", "feature_value", "shap_value"]


def display_name(feature: str) -> str:
    return K.FEATURE_LABELS.get(feature, feature.replace("_", " "))


def factors(value_cols: dict[str, str] | None = None) -> Column:
    """All 15 factors in canonical order (feature_value = un-imputed value)."""
    value_cols = value_cols or {f: f for f in K.MODEL_FEATURES}
    return F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(display_name(f)).alias("display_name"),
            F.col(value_cols[f]).cast("double").alias("feature_value"),
            F.col(shap_col(f)).cast("double").alias("shap_value"),
        )
        for f in K.MODEL_FEATURES
    ])


def _by_magnitude(arr: Column) -> Column:
    keyed = F.transform(arr, lambda x, i: F.struct(
        (-F.abs(x["shap_value"])).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda y: y["x"])


def top_factors(arr: Column, k: int = K.MAX_FACTORS) -> Column:
    """The k strongest factors by |contribution| (stable on ties)."""
    return F.slice(_by_magnitude(arr), 1, k)


def lowering(top: Column) -> Column:
    return F.filter(top, lambda x: x["shap_value"] < 0)


def increasing(top: Column) -> Column:
    return F.filter(top, lambda x: x["shap_value"] > 0)


def main_label(arr: Column) -> Column:
    """display name of the first factor, NULL for an empty list."""
    return F.get(arr, 0)["display_name"]


def with_factors(scored: DataFrame, k: int = K.MAX_FACTORS) -> DataFrame:
    """Add ``factors``, ``factors_lowering`` and ``factors_increasing``."""
    out = scored.withColumn("factors", factors())
    out = out.withColumn("_top", top_factors(F.col("factors"), k))
    return out.withColumn("factors_lowering", lowering(F.col("_top"))) \
              .withColumn("factors_increasing", increasing(F.col("_top"))).drop("_top")


def attribution_long(scored: DataFrame, keys: tuple[str, ...] = ("source_index",)) -> DataFrame:
    """F4 long form: one row per (night, feature) with its position."""
    return scored.select(*keys, F.posexplode(factors()).alias("pos", "factor")).select(
        *keys, (F.col("pos") + 1).alias("feature_position"),
        *[F.col("factor")[c].alias(c) for c in FACTOR_FIELDS])


def contribution_chart(low: Column, inc: Column, k: int = K.CHART_MAX_FACTORS) -> Column:
    """G1: both lists merged, strongest k by |value|, with a sign class."""
    top = F.slice(_by_magnitude(F.concat(low, inc)), 1, k)
    return F.transform(top, lambda x: F.struct(
        x["display_name"].alias("display_name"), x["shap_value"].alias("shap_value"),
        F.when(x["shap_value"] >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("sign")))
