"""M-1 as an incremental job: newly landed raw files -> staged Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession

from funnelworks.operators.staging import stage_events
from funnelworks.sources.events import date_range
from funnelworks.sources.schema import RAW_EVENT


def stage_incrementally(spark: SparkSession, raw_path: str, out_path: str, checkpoint: str,
                        start: str | None = None, end: str | None = None):
    """Stage every raw file not processed yet, then stop (``availableNow``).

    The file source records processed files and the Parquet file sink
    records committed output in its ``_spark_metadata`` log, both under the
    shared folders given, so a rerun after a failure neither skips nor
    duplicates anything (exactly-once); readers of ``out_path`` see only
    committed files. Output is partitioned by ``event_date``.
    Returns the finished ``StreamingQuery``.
    """
    raw = spark.readStream.schema(RAW_EVENT).parquet(raw_path)
    staged = stage_events(date_range(raw, start, end))
    q = (staged.writeStream.format("parquet").partitionBy("event_date")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
