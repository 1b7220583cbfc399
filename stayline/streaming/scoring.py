"""Continuous scoring.

The request endpoints of the original service become Structured Streaming
jobs.  Scoring is stateless - every record is scored by the same
projection as the batch path, with the *fitted* is_high_value threshold
(a constant), so a record scores identically alone, in a micro-batch or in
a batch.  No watermark or state is needed because nothing is aggregated
across records.  ``foreachBatch`` of S2 may see a batch again after a
restart, so a batch owns the folders ``batch_id=<id>`` of its outputs and
overwrites them: a replay leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline import config as C
from stayline.plans.score import score_and_account, score_batch, status_frame
from stayline.sources.io import RAW_SCHEMA

SCORE_COLS = ["customerID", "segment", "segment_label", "segment_confidence", "churn_prob", "is_churner",
              "action_key", "action_label", "priority", "reason"]


def stream_score(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                 high_value_threshold: float, tau: float = C.DEFAULT_THRESHOLD,
                 max_files_per_trigger: int | None = None):
    """Parquet files arriving in ``source_dir`` -> scored rows appended
    to ``sink_dir``.  Returns the started query (trigger: availableNow, so
    it drains what is there and stops; use processingTime for a service)."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(source_dir)
    scored = score_batch(raw, tau, high_value_threshold=high_value_threshold)
    return (scored.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).outputMode("append")
            .trigger(availableNow=True).start())


def stream_file_batches(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                        high_value_threshold: float, tau: float = C.DEFAULT_THRESHOLD,
                        max_files_per_trigger: int = 1):
    """Every dropped batch file is scored in its own micro-batch; the
    predictions and one status row (input, processed, failed, churners,
    customers by action) are written below the batch's own ``batch_id=`` folder."""
    raw = (spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        status = score_and_account(batch, f"{out_dir}/predictions/batch_id={batch_id}", tau, high_value_threshold)
        (status_frame(batch.sparkSession, status).select("rows_input", "rows_processed", "churners", "failed", "action_counts")
         .coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/status/batch_id={batch_id}"))

    return (raw.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
