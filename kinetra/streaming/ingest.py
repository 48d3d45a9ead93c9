"""Sources and sinks of streams: Kafka in production, file drops and memory where there is no broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Late reports are waited for as long as an alert lives.
WATERMARK = "30 seconds"


def kafka_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int = 10_000) -> DataFrame:
    """A topic's messages; per_trigger bounds a batch as the queue's capacity does."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_trigger).load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp", "topic")


def dropped_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Lines of JSON files that land in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)


def keyed_json(rows: DataFrame, key: str) -> DataFrame:
    """Rows as messages: the key as text, and all columns as JSON."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def to_kafka(rows: DataFrame, servers: str, topic: str, key: str, checkpoint: str) -> DataStreamWriter:
    """Rows as JSON keyed by a column."""
    return keyed_json(rows, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def to_console(rows: DataFrame, mode: str = "append") -> DataStreamWriter:
    return rows.writeStream.format("console").outputMode(mode)


def to_each(rows: DataFrame, publish, checkpoint: str) -> DataStreamWriter:
    """Hand every batch (DataFrame, batch id) to publish: other brokers, stores, callbacks."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
