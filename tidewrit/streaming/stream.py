"""Preprocessing of message streams: P0 is stateless, so the batch columns work unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.prepro import rewrite_text


def message_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def preprocessed(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Each message once, preprocessed: second deliveries within ``late`` of event time are dropped, and their state with them."""
    once = stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["msg_id"])
    return once.select("msg_id", "channel", "ingested_at", rewrite_text(F.col("text_orig")).alias("text_prepro"))


def channel_counts(stream: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Messages and blank messages of each channel in each window of arrival."""
    t = stream.withWatermark("ingested_at", late)
    return t.groupBy(F.window("ingested_at", window).alias("w"), "channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("text_orig"), F.lit("")) == "").alias("blank"))


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
