"""Blocks as a stream: what needs one row at a time runs unchanged on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import blocks


def read_blocks(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cleaned(stream: DataFrame, width: float = blocks.PAGE_WIDTH, height: float = blocks.PAGE_HEIGHT) -> DataFrame:
    """Page filter, normalised text and hash of every block; no state."""
    x = blocks.inside_page(stream, F.lit(width), F.lit(height))
    return x.withColumn("text", text.normalize_text(text.text_of("text"))).withColumn("content_hash", text.content_hash(F.col("text")))


def type_counts(stream: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Blocks by type in windows of event time; rows later than the watermark go."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "block_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
