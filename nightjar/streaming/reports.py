"""The table-level report and summary of a stream, one after each micro-batch.

The counts behind C12-C14 and F11 are a streaming aggregate: Spark keeps one row of
them as state under the query's checkpoint and adds the partial counts of each micro-batch. A
report is so that of all rows that came until then, also after a restart. Reports are
stored by the number of their batch, and a batch that is repeated after a failure replaces its own. A
stream that hasn't had a row yet has no report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nightjar import constants as K
from nightjar.operators.quality import schema_columns, schema_counts, schema_report
from nightjar.operators.score import score_nights, summary_aggregates
from nightjar.session import tune_session
from nightjar.sinks.export import committed


def table_counts(nights: DataFrame, scorer) -> DataFrame:
    """One row: the counts of the schema report and of the batch summary, of a static or streaming table."""
    missing = schema_columns(nights.columns)["missing"]
    if missing:
        raise ValueError(K.SCHEMA_MISSING + ", ".join(missing))
    scored = score_nights(nights, scorer).withColumnRenamed("prediction", "predicted_efficiency")
    return scored.agg(*schema_counts(), *summary_aggregates()[1:])


def start_report_stream(nights: DataFrame, scorer, reports_dir: str, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Writes the report of each micro-batch to ``reports_dir``; ``nights`` is a streaming table."""
    columns = nights.columns

    def store(counts: DataFrame, batch: int) -> None:
        rows = counts.persist()  # the state's one row
        report = schema_report(rows, columns).crossJoin(rows.drop("n_rows", "n_valid_rows", "n_error_rows"))
        with committed(counts.sparkSession, f"{reports_dir.rstrip('/')}/batch={batch}") as folder:
            report.coalesce(1).write.parquet(folder)
        rows.unpersist()

    tune_session(nights.sparkSession)
    writer = table_counts(nights, scorer).writeStream.outputMode("complete").option("checkpointLocation", checkpoint_dir).foreachBatch(store)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def read_reports(spark: SparkSession, reports_dir: str) -> DataFrame:
    """All reports, with the number of their ``batch``; the one with the highest is the last."""
    return spark.read.parquet(reports_dir).withColumn("batch", F.col("batch").cast("long"))
