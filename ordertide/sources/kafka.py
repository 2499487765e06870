"""Kafka topic of JSON order events. Needs Spark's Kafka connector on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.contract import DEFAULT_TOPIC
from ordertide.functions.payload import decode_payload
from ordertide.operators.quality import is_complete
from ordertide.sources.files import RAW

OFFSETS = ("kafka_topic", "kafka_partition", "kafka_offset")


def stream_records(
    spark: SparkSession,
    bootstrap: str,
    topic: str = DEFAULT_TOPIC,
    starting_offsets: str = "earliest",
    **options: str,
) -> DataFrame:
    """Raw records of one topic. ``options`` are passed to the connector, for example
    ``maxOffsetsPerTrigger`` or ``minPartitions`` to split a hot topic partition over tasks."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    return reader.options(**options).load()


def records_to_bronze(records: DataFrame) -> DataFrame:
    """Decode records and keep where each came from; ``event_date`` is the UTC event date.

    ``raw_record`` is the value of records that lack a required field, so that they can be traced
    after the topic has dropped them.
    """
    located = records.select(
        "value",
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
    )
    decoded = decode_payload(located, *OFFSETS, "value")
    raw = F.when(~is_complete(), F.col("value").cast("string"))
    return decoded.withColumns({RAW: raw, "event_date": F.to_date("event_ts")}).drop("value")
