"""K1-K4: writers. Nothing passes the driver, and files appear all at once or not at all.

Everything is written into a hidden folder beside the target, which takes the target's
place by a rename when all of it is there. A failure leaves the target as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.lineage import Tables
from nightjar.operators.report import result_json
from nightjar.operators.score import input_preview, processing_errors

# FIXED VALUES: part names of the three-part export.
EXPORT_PARTS = ("Analysis_Results", "Processing_Errors", "Input_Preview")

#: What may be there already: replaced ("overwrite") or refused ("error").
MODES = ("overwrite", "error")


@contextmanager
def committed(spark: SparkSession, path: str, mode: str = "overwrite") -> Iterator[str]:
    """A folder to write into that becomes ``path`` at the end of the block, or goes if the block fails."""
    if mode not in MODES:
        raise ValueError(f"Files that appear at once can't be written in mode {mode!r}; use one of {MODES}.")
    place = spark._jvm.org.apache.hadoop.fs.Path
    target, token = place(path), uuid.uuid4().hex
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target = fs.makeQualified(target)
    if mode == "error" and fs.exists(target):
        raise FileExistsError(f"There is something at {path} already.")
    fs.mkdirs(target.getParent())
    staged, former = (place(target.getParent(), f".{target.getName()}-{token}{end}") for end in ("", "-former"))
    try:
        yield staged.toString()
        replaces = fs.exists(target)
        if replaces and not fs.rename(target, former):
            raise OSError(f"{path} can't be moved aside.")
        if not fs.rename(staged, target):
            if replaces:
                fs.rename(former, target)
            raise OSError(f"The files for {path} can't be moved there.")
        if replaces:
            fs.delete(former, True)
    finally:
        fs.delete(staged, True)  # nothing is left there after a success


def write_batch_csv(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: results as UTF-8 CSV with a header, no index."""
    with committed(results.sparkSession, path, mode) as folder:
        results.write.option("header", True).option("encoding", "UTF-8").csv(folder)


def write_batch_export(results: DataFrame, errors: DataFrame | None, path: str, preview: DataFrame | None = None,
                       fmt: str = "parquet", mode: str = "overwrite") -> list[str]:
    """K2: results (rows without error), errors, optional preview of at most 100 rows.

    ``results`` are computed once and kept as Parquet until the parts are cut from them;
    without ``errors`` the error part is cut from them too.
    """
    if preview is not None and "source_index" not in preview.columns:
        raise ValueError("The preview needs source_index, which says what its first rows are.")
    spark = results.sparkSession
    tables = Tables(spark)
    with committed(spark, path, mode) as folder, tables.dropped_at_end():
        rows = tables.write(results, "results")
        parts = [(EXPORT_PARTS[0], rows.filter(F.col("error").isNull())), (EXPORT_PARTS[1], processing_errors(rows) if errors is None else errors)]
        if preview is not None:
            parts.append((EXPORT_PARTS[2], input_preview(preview)))
        for name, df in parts:
            writer = df.write.option("header", True) if fmt == "csv" else df.write
            writer.format(fmt).save(f"{folder}/{name}")
    return [name for name, _ in parts]


def write_result_json(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """K3: one privacy-filtered JSON document per row (text files)."""
    with committed(df.sparkSession, path, mode) as folder:
        df.select(result_json(df, columns).alias("value")).write.text(folder)


def save_evaluation_outputs(path: str, summary: DataFrame, fold_metrics: DataFrame, predictions: DataFrame,
                            mode: str = "overwrite") -> None:
    """K4: metrics JSON, fold-metric CSV and a six-column prediction CSV."""
    if "source_index" in predictions.columns:  # files in the order of the source rows
        predictions = predictions.orderBy("source_index")
    with committed(summary.sparkSession, path, mode) as folder:
        summary.coalesce(1).write.json(f"{folder}/evaluation")
        fold_metrics.coalesce(1).write.option("header", True).csv(f"{folder}/fold_metrics")
        predictions.select(*K.OOF_COLUMNS).write.option("header", True).csv(f"{folder}/test_predictions")
