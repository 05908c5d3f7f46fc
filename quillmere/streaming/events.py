"""Event streams: checked, routed and quarantined in micro-batches, and counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmere.operators.records import checked_events, routed


def write_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends accepted events to path/events, by stream and day, and refused ones to path/quarantine with the reason.

    A batch that runs again replaces what it wrote: its number is part of the folder's name.
    """

    def save(batch: DataFrame, n: int) -> None:
        x = routed(checked_events(batch)).withColumn("day", F.to_date("ts"))
        x.where("rejected is null").drop("rejected", "document").write.mode("overwrite").partitionBy("stream", "day").parquet(f"{path}/events/batch={n}")
        x.where("rejected is not null").drop("document").write.mode("overwrite").parquet(f"{path}/quarantine/batch={n}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and time window; what comes later than `late` is dropped."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
