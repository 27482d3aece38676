"""The validation -> features -> score -> attribution -> result flow on a stream.

Every step of the batch flow is row-local (projections only), so the same
operators apply unchanged to a streaming DataFrame: no state, no watermark
is needed. The model's fitted values are literals (linear scorer) or a
broadcast model (trees), fitted beforehand in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from nightjar.operators.score import batch_results, score_nights
from nightjar.sources.nights import NIGHT_VIEW_COLUMNS


def score_stream(nights: DataFrame, scorer) -> DataFrame:
    """Batch-result rows for a (streaming or static) night DataFrame."""
    return batch_results(score_nights(nights, scorer), scorer.model_mae)


def start_scoring_stream(spark: SparkSession, source_dir: str, schema: StructType, scorer, sink_dir: str,
                         checkpoint_dir: str, from_events: bool = False, fmt: str = "parquet",
                         available_now: bool = True) -> StreamingQuery:
    """Read files as they arrive, write result rows to ``sink_dir`` (exactly once via the checkpoint)."""
    source = spark.readStream.schema(schema).format(fmt).load(source_dir)
    nights = source.selectExpr(*NIGHT_VIEW_COLUMNS) if from_events else source
    writer = (score_stream(nights, scorer).writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
