"""Extension: incremental ingestion of annotation rows with Structured Streaming.

The batch pipeline resumes by an anti-join against finished slides; a stream does the same with a checkpoint. Late rows
are bounded by a watermark, and every micro-batch is written with its id, so a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def events(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Event time as a timestamp: watermarks take no timestamp without a time zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def class_rates(stream: DataFrame, time: str = "ts", column: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each class by tumbling window; state of windows older than the watermark is dropped."""
    counts = _timed(stream, time).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), column).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), column, "n")


def once_each(stream: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return _timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def write_batches(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append micro-batches as Parquet under batch=<id>; a batch that is run again overwrites itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
